"""Which relation a new memory has to a stored one, and what is to be done about it.

All of it is expressions over pairs that recall or blocking has found; only the ratio of two texts
needs Python, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import single_spaced
from mnemospark.operators.rows import best_per_key

#: Priority of a relation when several stored memories were compared (fixed values).
PRIORITY = {"DUPLICATE": 70, "CONTRADICTS": 60, "SUPERSEDES": 50, "SUPPORTS": 40, "EXTENDS": 30, "UNKNOWN": 20, "UNRELATED": 10}

#: What each relation asks for, in order (fixed values).
ACTIONS = {
    "DUPLICATE": ["MERGE_EVIDENCE", "NOOP"],
    "CONTRADICTS": ["CREATE_CONTEXT", "CREATE_RELATION", "CREATE_CONFLICT_SET", "QUEUE_REVIEW"],
    "SUPERSEDES": ["CREATE_CONTEXT", "CREATE_RELATION", "MARK_SUPERSEDED", "QUEUE_REVIEW"],
    "SUPPORTS": ["MERGE_EVIDENCE", "CREATE_RELATION"],
    "EXTENDS": ["CREATE_CONTEXT", "CREATE_RELATION"],
    "UNKNOWN": ["CREATE_CONTEXT", "PRESERVE_CANDIDATE", "QUEUE_REVIEW"],
    "UNRELATED": ["CREATE_CONTEXT"],
}


def text_ratio(a: Column, b: Column) -> Column:
    """How alike two texts are, 0 to 1: twice the matched characters over all characters; null for a
    null text."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def claim_evidence(a: Column, b: Column) -> Column:
    """How claim a compares with claim b. A claim is a struct of subject, predicate, object, polarity
    and qualifiers (an array of strings). Words compare in any case, white space single.

    overlap: four fifths for the equal ones of the three parts, one fifth for the share of common
    qualifiers (all of it where neither has any)."""
    same = {f: F.lower(single_spaced(a[f])).eqNullSafe(F.lower(single_spaced(b[f]))) for f in ("subject", "predicate", "object")}
    qa, qb = F.array_distinct(a["qualifiers"]), F.array_distinct(b["qualifiers"])
    all_, common = F.size(F.array_union(qa, qb)), F.size(F.array_intersect(qa, qb))
    polarity = a["polarity"].eqNullSafe(b["polarity"])
    topic = same["subject"] & same["predicate"]
    proposition = topic & same["object"]
    parts = sum((s.cast("int") for s in same.values()), F.lit(0))
    return F.struct(
        (proposition & polarity & (common == all_)).alias("exact"),
        topic.alias("same_topic"),
        (topic & ~(same["object"] & polarity)).alias("conflict"),
        (proposition & polarity & (common == F.size(qb)) & (F.size(qa) > F.size(qb))).alias("more_specific"),
        (parts / 3 * 0.8 + F.when(all_ == 0, 1.0).otherwise(common / all_) * 0.2).alias("overlap"),
    )


def classify(claim: Column, ratio: Column, *, same_hash: Column, same_source: Column, compatible: Column, independent: Column, overlapping: Column, newer: Column) -> Column:
    """relation, confidence and source of a pair; the first rule that holds decides. claim is what
    claim_evidence says of the pair's best claims, null where they have none to compare. Unknown
    (null) conditions count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    said = lambda relation, confidence, source: F.struct(F.lit(relation).alias("relation"), F.lit(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"))
    unlike, none = yes(ratio < 0.35), claim.isNull()
    return (
        F.when(yes(same_hash), said("DUPLICATE", 1.0, "deterministic"))
        .when(yes(same_source) & yes(ratio >= 0.98), said("DUPLICATE", 0.99, "deterministic"))
        .when(~yes(compatible), said("UNRELATED", 0.98, "deterministic"))
        .when(none & unlike, said("UNRELATED", 0.75, "semantic"))
        .when(none, said("UNKNOWN", 0.4, "semantic"))
        .when(claim["exact"] & yes(independent), said("SUPPORTS", 0.98, "deterministic"))
        .when(claim["exact"], said("DUPLICATE", 0.98, "deterministic"))
        .when(claim["conflict"] & yes(overlapping), said("CONTRADICTS", 0.96, "deterministic"))
        .when(claim["same_topic"] & yes(newer) & ~yes(overlapping), said("SUPERSEDES", 0.95, "deterministic"))
        .when(claim["more_specific"], said("EXTENDS", 0.9, "deterministic"))
        .when((claim["overlap"] >= 0.75) & yes(ratio >= 0.7), said("EXTENDS", 0.78, "semantic"))
        .when((claim["overlap"] < 0.25) & unlike, said("UNRELATED", 0.9, "semantic"))
        .otherwise(said("UNKNOWN", 0.45, "semantic"))
    )


def primary_decisions(decisions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The decision of highest priority, then confidence, for each candidate; equals by order."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("relation")]
    return best_per_key(decisions, keys, [F.desc(rank), F.desc("confidence"), *order])


def actions(primary: DataFrame) -> DataFrame:
    """primary with one row for each action and its step (from 0). A candidate that was compared with
    nothing (null relation) is created."""
    rules = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = F.coalesce(rules[F.col("relation")], F.array(F.lit("CREATE_CONTEXT")))
    return primary.select("*", F.posexplode(wanted).alias("step", "action"))


def plan_key(*parts: Column) -> Column:
    """The key that makes a plan idempotent: sha256 of its parts joined by |; nulls are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


#: Least confidence of a model's proposal, and of one that finds no relation (fixed values).
PROPOSAL, PROPOSAL_UNRELATED = 0.65, 0.85


def with_proposal(relation: Column, confidence: Column, proposal: Column, scores: Column, *, overlapping: Column, newer: Column) -> Column:
    """relation, confidence, source after a model's proposal (relation, confidence): it is taken only where
    the rules left UNKNOWN, it is sure enough, and the scores (semantic, claim, scope, polarity_conflict,
    temporal) bear it out."""
    p, sure = proposal["relation"], proposal["confidence"]
    fits = (
        F.when(p == "UNRELATED", (sure >= PROPOSAL_UNRELATED) & (scores["semantic"] < 0.5)).when(scores["scope"] == 0, False)
        .when(p == "DUPLICATE", F.greatest(scores["semantic"], scores["claim"]) >= 0.85).when(p == "SUPPORTS", (scores["claim"] >= 0.65) & (scores["polarity_conflict"] == 0))
        .when(p == "EXTENDS", (scores["claim"] >= 0.5) & (scores["polarity_conflict"] == 0)).when(p == "CONTRADICTS", (scores["temporal"] == 1) & (scores["polarity_conflict"] == 1))
        .when(p == "SUPERSEDES", ~overlapping & newer).otherwise(False)
    )
    taken = F.coalesce((relation == "UNKNOWN") & (p != "UNKNOWN") & (sure >= PROPOSAL) & fits, F.lit(False))
    return F.struct(F.when(taken, p).otherwise(relation).alias("relation"), F.when(taken, sure).otherwise(confidence).alias("confidence"), F.when(taken, "llm").otherwise("deterministic").alias("source"))


def plan(primary: DataFrame, key: list[Column], has_claims: Column) -> DataFrame:
    """primary (relation null where nothing was recalled) with requires_review, warnings, status and
    idempotency_key: what a plan says beside its actions."""
    relation = F.coalesce("relation", F.lit("UNRELATED"))
    review = relation.isin("CONTRADICTS", "SUPERSEDES", "UNKNOWN")
    warnings = [
        F.when(~has_claims, "no_claims"), F.when(F.col("relation").isNull(), "nothing_recalled"), F.when(relation == "CONTRADICTS", "unresolved_contradiction"),
        F.when(relation == "SUPERSEDES", "supersession_needs_approval"), F.when(relation == "UNKNOWN", "low_confidence"),
    ]
    return primary.select("*", review.alias("requires_review"), F.array_compact(F.array(*warnings)).alias("warnings"), F.when(review, "REVIEW_REQUIRED").otherwise("PLANNED").alias("status"), plan_key(*key).alias("idempotency_key"))


def cycle_flags(relation: Column, review: Column) -> dict[str, Column]:
    """The buckets of a maintenance cycle that a context falls in; one may be in several."""
    planned = relation.isNotNull()
    is_ = lambda *words: F.coalesce(relation.isin(*words), F.lit(False))
    needs = F.coalesce(review, F.lit(False)) & planned
    special = is_("DUPLICATE", "CONTRADICTS", "SUPERSEDES")
    return {
        "retained": ~special & ~needs, "duplicates": is_("DUPLICATE"), "supersession": is_("SUPERSEDES"), "contradictions": is_("CONTRADICTS"), "summary": ~planned | is_("SUPPORTS", "EXTENDS"),
        "relations": is_("SUPPORTS", "EXTENDS"), "review": is_("CONTRADICTS", "SUPERSEDES") | (~special & needs),
    }


def cycle_buckets(plans: DataFrame) -> DataFrame:
    """bucket, n: how many contexts of plans (relation, requires_review) each bucket of a cycle has."""
    flags = cycle_flags(F.col("relation"), F.col("requires_review"))
    one = plans.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    return one.select(F.explode(F.create_map(*[x for k in flags for x in (F.lit(k), F.col(k))])).alias("bucket", "n"))


def sweep_counters(plans: DataFrame) -> DataFrame:
    """One row about a sweep over stored contexts: scanned, planned, review, unrelated, and plans that were
    made twice (by their keys)."""
    return plans.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("relation").isNotNull()).alias("planned"), F.count_if("requires_review").alias("review"),
        F.count_if(F.coalesce(F.col("relation") == "UNRELATED", F.lit(False))).alias("unrelated"), (F.count(F.lit(1)) - F.countDistinct("idempotency_key")).alias("repeated"),
    )


def fact_category(conflicts: Column, known: Column, superseded_by: Column, current: Column, valid_to: Column) -> Column:
    """What kind of fact a context is in a compact."""
    return (
        F.when(F.size(conflicts) > 0, "OPEN_CONFLICT").when(~known, "UNCERTAIN").when(superseded_by.isNotNull(), "SUPERSEDED").when(current, "CURRENT")
        .when(valid_to.isNotNull(), "HISTORICAL").otherwise("UNCERTAIN")
    )


def safety_issues(facts: DataFrame) -> DataFrame:
    """issue for each way in which facts (context_id, category, content, evidence, conflicts, valid_to,
    superseded_by) would mislead a reader of the compact."""
    flat = F.lower(single_spaced(F.col("content")))
    current = facts.where("category = 'CURRENT'")
    found = {
        "TEMPORAL_STATE_COLLAPSE": facts.groupBy("context_id").agg(F.countDistinct("category").alias("n")).where("n > 1"),
        "DUPLICATE_CLAIM_INFLATION": facts.groupBy(flat.alias("t")).agg(F.countDistinct("context_id").alias("n")).where("n > 1"),
        "UNSUPPORTED_MERGE": current.where("size(evidence) = 0"),
        "SUPERSEDED_FACT_PRESENTED_AS_CURRENT": current.where("valid_to is not null or superseded_by is not null"),
        "UNRESOLVED_CONTRADICTION_LEAKAGE": current.where("size(conflicts) > 0"),
    }
    parts = [df.limit(1).select(F.lit(name).alias("issue")) for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Namespace of ids made from names: that of URLs (a fixed value of RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_id(name: Column) -> Column:
    """The version 5 UUID of a name: SHA-1 of namespace and name, with the bits that tell version and kind."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    kind = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(kind, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Sections that a compact's review looks for, and items that must have full points (fixed values).
RUBRIC_SECTIONS = {"durable_decisions": "Durable Decisions", "current_state": "Current State", "risks_blockers": "Risks and Blockers", "next_actions": "Next Actions"}
RUBRIC_FULL = ["evidence_completeness", "current_state", "project_isolation"]


def section_text(body: Column, heading: str) -> Column:
    """What stands under a second-level heading; empty where it isn't there."""
    return F.trim(F.regexp_extract(body, rf"(?ms)^## {heading}[ \t]*\n(.*?)(?=^## |\z)", 1))


def compact_review(compacts: DataFrame) -> DataFrame:
    """compacts (body, project, missing_refs, unlinked_refs, stale, open_conflicts) with points for ten items
    of 0 to 2, total, verdict and publishable."""
    thin = lambda t: F.when(t == "", 0).when(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) < 3, 1).otherwise(2)
    body, project = F.col("body"), F.lower("project")
    items = {k: thin(section_text(body, h)) for k, h in RUBRIC_SECTIONS.items()}
    lines = F.filter(F.transform(F.split(F.lower(body), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("- project:") | x.startswith("project:"))
    items |= {
        "evidence_completeness": F.when(F.col("missing_refs") > 0, 0).when(F.col("unlinked_refs") > 0, 1).otherwise(2),
        "project_isolation": F.when(project.isNull(), 2).when(F.exists(lines, lambda x: ~x.contains(project)), 0).when(F.lower(body).contains(project), 2).otherwise(1),
        "freshness": F.when(F.col("stale"), 0).otherwise(2),
        "concision": F.when(F.length(body) > 12_000, 0).when(F.length(body) > 8_000, 1).otherwise(2),
        "contradiction_handling": F.when(~F.col("open_conflicts") | (section_text(body, "Open Conflicts") != ""), 2).otherwise(0),
        "actionability": thin(section_text(body, "Next Actions")),
    }
    out = compacts.select("*", *[c.alias(k) for k, c in items.items()])
    total = sum((F.col(k) for k in items), F.lit(0))
    full = F.lit(True)
    for k in RUBRIC_FULL:
        full = full & (F.col(k) == 2)
    verdict = F.when(F.col("stale") | (F.col("project_isolation") == 0), "BLOCKED").when((total < 17) | ~full, "NEEDS_REVISION").otherwise("PASS")
    return out.select("*", total.alias("total"), verdict.alias("verdict"), (total == 20).alias("publishable"))
