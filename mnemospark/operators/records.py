"""Notes, contexts and their logs as tables: predicates, probes, pages, health counts, writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.text import single_spaced
from mnemospark.operators.rows import best_per_key, with_running_sum

#: Identities of a context, in the order in which a probe compares them (fixed values).
IDENTITIES = ["project", "workspace_id", "agent_id", "user_id", "session_id"]


def effective_scope(scope: Column, kind: Column, project: Column) -> Column:
    """A note's scope: the one it states, in upper case; without one, notes other than contexts belong
    to their project, or to all where they have none. A context without a scope has none."""
    stated = F.nullif(F.upper(F.trim(scope)), F.lit(""))
    implied = F.when(F.nullif(F.trim(project), F.lit("")).isNotNull(), "PROJECT").otherwise("GLOBAL")
    return F.coalesce(stated, F.when(~kind.eqNullSafe(F.lit("context")), implied))


def outside(path: Column, prefix: str) -> Column:
    """Paths that don't begin with prefix, whatever signs it has; null paths are outside."""
    return ~F.coalesce(path.startswith(prefix), F.lit(False))


def has_alias(aliases: Column, wanted: str) -> Column:
    """Any of the aliases (an array) equals wanted, in any case, white space single."""
    fold = lambda c: F.lower(single_spaced(c))
    return F.coalesce(F.exists(aliases, lambda a: fold(a) == fold(F.lit(wanted))), F.lit(False))


def strictly_in_scope(scope: Column, wanted: dict[str, tuple[Column, str]], workspace: Column, workspace_id: str | None) -> Column:
    """The check of scopes after retrieval: a scope that was asked for, with its identity, and the very
    workspace that was asked for: none is a workspace of its own, and an empty one is not none."""
    tests = [(scope == name) & (F.lit(True) if name == "GLOBAL" else column == value) for name, (column, value) in wanted.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False)) & workspace.eqNullSafe(F.lit(workspace_id))


def stale_embedding(model: Column, dims: Column, fingerprint: Column, *, current: tuple[str, int, str]) -> Column:
    """An embedding that is missing or was made another way. Unknown (null) values count as other."""
    same = model.eqNullSafe(F.lit(current[0])) & dims.eqNullSafe(F.lit(current[1])) & fingerprint.eqNullSafe(F.lit(current[2]))
    return ~same


def duplicate_probe(contexts: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """For each candidate the stored context with the same kind, scope, content hash and identities (null
    equals null), the smallest key but its own: key, duplicate_of (null without one)."""
    same = ["kind", "scope", "content_hash", *[c for c in IDENTITIES if c in contexts.columns]]
    # nulls hash together as a struct's JSON, so the join stays on one plain key
    mark = F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256)
    marked = contexts.select(key, mark.alias("_m"))
    stored = marked.groupBy("_m").agg(F.min(key).alias("_a"))
    second = marked.join(stored, "_m").where(F.col(key) != F.col("_a")).groupBy("_m").agg(F.min(key).alias("_b"))
    found = candidates.withColumn("_m", mark).join(stored, "_m", "left").join(second, "_m", "left")
    return found.select(F.col(key), F.when(F.col("_a") != F.col(key), F.col("_a")).otherwise(F.col("_b")).alias("duplicate_of"))


def hydrated(ranked: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records that a ranked list (key, rank) names, with their rank; keys without a record go.
    The ranked side is a page of results; where its size is known to be small Spark broadcasts it."""
    return records.join(ranked.select(key, "rank"), key).orderBy("rank")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page and, on each of its rows, total: how many rows there are."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, offset, limit).withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def health(jobs: DataFrame, status: str, at: str, error: str, states: list[str]) -> DataFrame:
    """One row: how many jobs there are, how many in each state, and the latest failure's time and error."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in states]
    failed = F.when(F.col(status) == "FAILED", F.struct(at, error))
    return jobs.agg(F.count(F.lit(1)).alias("total"), *counts, F.max(failed).alias("_f")).select("*", F.col(f"_f.{at}").alias("last_failure_at"), F.col(f"_f.{error}").alias("last_error")).drop("_f")


def repeated_keys(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys that several different members have, and how many."""
    return df.groupBy(key).agg(F.countDistinct(member).alias("members")).where("members > 1")


def issue_counts(issues: DataFrame, code: str = "code") -> DataFrame:
    return issues.groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def findings(rows: DataFrame, code: str, note: str, field: str) -> DataFrame:
    """For each code: findings, notes and fields that have it."""
    return rows.groupBy(code).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct(note).alias("notes"), F.countDistinct(field).alias("fields"))


def failure_balance(rows: DataFrame, code: Column) -> DataFrame:
    """One row: scanned, valid, invalid, failures (a map from code to count, codes in order) and
    balanced (valid and invalid make up all). A null code is a valid row."""
    coded = rows.select(code.alias("_c")).groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))  # a row per code
    failed = F.when(F.col("_c").isNotNull(), F.struct("_c", "_n"))
    total, valid = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_c").isNull(), F.col("_n"))), F.lit(0))
    invalid = F.coalesce(F.sum(F.when(F.col("_c").isNotNull(), F.col("_n"))), F.lit(0))
    return coded.agg(total.alias("scanned"), valid.alias("valid"), invalid.alias("invalid"), F.map_from_entries(F.sort_array(F.collect_list(failed))).alias("failures")).withColumn("balanced", F.col("valid") + F.col("invalid") == F.col("scanned"))


def union_of(lanes: list[DataFrame], key: str) -> DataFrame:
    """The keys that any lane found, each once."""
    return reduce(DataFrame.union, [x.select(key) for x in lanes]).distinct()


def by_time_preference(df: DataFrame, at: str, rank: str) -> DataFrame:
    """Rows with new ranks from 1: those with a time come first, the newest ahead; the others keep their order."""
    order = Window.orderBy(F.col(at).desc_nulls_last(), rank)  # a page of results
    return df.withColumn("new_rank", F.row_number().over(order))


def by_role_preference(df: DataFrame, role: str, preferred: list[str], rank: str) -> DataFrame:
    """Rows with new ranks from 1: preferred roles in their order, then all others; within a role as before."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(role))
    bucket = F.when(F.coalesce(place, F.lit(0)) == 0, len(preferred) + 1).otherwise(place)
    return df.withColumn("new_rank", F.row_number().over(Window.orderBy(bucket, rank)))


# -- state and writes --------------------------------------------------------------------------------


def compiled_state(notes: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """note_id, source_hash, chunk_hashes (by index), edge_ids (in order) of each note. A note's lists
    are as long as the note has chunks and links."""
    c = chunks.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash"))), lambda x: x["content_hash"]).alias("chunk_hashes"))
    e = edges.groupBy("note_id").agg(F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))
    none = F.array().cast("array<string>")
    return notes.select("note_id", "source_hash").join(c, "note_id", "left").join(e, "note_id", "left").select("note_id", "source_hash", F.coalesce("chunk_hashes", none).alias("chunk_hashes"), F.coalesce("edge_ids", none).alias("edge_ids"))


def replaced(stored: DataFrame, new: DataFrame, key: str = "note_id") -> DataFrame:
    """stored with the rows of new in place of those that share their key."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def carried_embeddings(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new chunks with the embedding of the stored chunk that has their note, index and content hash
    (null where none has)."""
    keys = ["note_id", "chunk_index", "content_hash"]
    old = stored.groupBy(*keys).agg(F.first("embedding", ignorenulls=True).alias("embedding"))
    return new.drop("embedding").join(old, keys, "left")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in gone: the cascade of a removal, table by table."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def with_sequence(changes: DataFrame, last: int, order: list[str]) -> DataFrame:
    """changes with the next sequence numbers after last, without gaps, in the given order. One write
    at a time allocates them; a batch is what one write brings. The order has no ties; its ranges are
    numbered each by itself."""
    numbered = with_running_sum(changes.withColumn("_one", F.lit(1).cast("long")), order, "_one", "sequence")
    return numbered.withColumn("sequence", F.col("sequence") + F.lit(last)).drop("_one")


def access_counters(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("access_count"), F.max(at).alias("last_accessed_at"))


def change_kind(existed: Column, old_status: Column, new_status: Column, old_hash: Column, new_hash: Column) -> Column:
    """What a write did to a context: created, superseded, archived, updated; null where it did nothing."""
    moved = ~old_status.eqNullSafe(new_status)
    return (
        F.when(~existed, "created").when(moved & (new_status == "superseded"), "superseded").when(moved & (new_status == "archived"), "archived")
        .when(~old_hash.eqNullSafe(new_hash), "updated")
    )


def consistent_status(status: Column, attempts: Column, finished: Column, error: Column) -> Column:
    """A job's fields agree with its status: only ended ones have an end, failed ones an error, those
    that run or retry an attempt."""
    ended = status.isin("SUCCEEDED", "FAILED")
    return (ended == finished.isNotNull()) & ((status == "FAILED") == error.isNotNull()) & (~status.isin("RUNNING", "RETRYING", "SUCCEEDED", "FAILED") | (attempts > 0)) & status.isin("QUEUED", "RUNNING", "RETRYING", "SUCCEEDED", "FAILED")


def latest_status(log: DataFrame, job: str, attempt: str, at: str, status: str) -> DataFrame:
    return best_per_key(log.select(job, attempt, at, status), [job], [F.desc(attempt), F.desc(at), F.asc(status)])


def artifact_drift(repository: DataFrame, mirror: DataFrame) -> DataFrame:
    """name, reason for every artifact (name, digest) whose published copy is missing, is not in the
    repository any more, or differs; null reason where both agree."""
    both = repository.select("name", F.col("digest").alias("_r")).withColumn("_in", F.lit(True)).join(mirror.select("name", F.col("digest").alias("_m")).withColumn("_out", F.lit(True)), "name", "full_outer")
    reason = F.when(F.col("_out").isNull(), "missing_in_mirror").when(F.col("_in").isNull(), "missing_in_repository").when(~F.col("_r").eqNullSafe(F.col("_m")), "hash_mismatch")
    return both.select("name", reason.alias("reason"))


def overall_status(status: Column, ready: Column, warnings: Column, integrity: Column) -> Column:
    """Readiness of service and data as one word."""
    return (
        F.when(status == "RECOVERING", "RECOVERING").when(ready & (warnings | (integrity != "HEALTHY")), "READY_WITH_WARNINGS").when(ready, "READY")
        .when(status.isin("DEGRADED_FTS_ONLY", "UNKNOWN", "VERIFYING"), "DEGRADED").otherwise("NOT_READY")
    )


def current_per_project(compacts: DataFrame) -> DataFrame:
    """compacts with status: of a project's the newest is CURRENT, all others are SUPERSEDED."""
    newest = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("updated_at"), "id"))
    return compacts.withColumn("status", F.when(newest == 1, "CURRENT").otherwise("SUPERSEDED"))


#: What a context's scope and status may be (fixed values).
SCOPES, STATUSES = ["GLOBAL", "PROJECT", "AGENT", "USER", "SESSION"], ["active", "current", "saved", "draft", "archived", "superseded"]


def context_of(notes: DataFrame) -> DataFrame:
    """context_id, scope, kind, created_at of notes as contexts: the scope stated, else by the identity at
    hand; the kind stated, else that of the note; times fall back to when the note was read."""
    scope = effective_scope(F.col("scope"), F.lit("note"), F.col("project"))
    kind = F.upper(F.coalesce("kind", "note_type"))
    return notes.select(F.concat(F.lit("note:"), "note_id").alias("context_id"), scope.alias("scope"), kind.alias("kind"), F.coalesce("created_at", "indexed_at").alias("created_at"))


def context_error(scope: Column, status: Column, project: Column, created_at: Column) -> Column:
    """The first thing that is wrong with a context's front matter; null where nothing is."""
    name, state = F.upper(F.trim(scope)), F.lower(F.trim(status))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "SCOPE_REQUIRED").when(~name.isin(SCOPES), "SCOPE_INVALID").when(~F.coalesce(state, F.lit("active")).isin(STATUSES), "STATUS_INVALID")
        .when((name == "PROJECT") & (F.coalesce(F.trim(project), F.lit("")) == ""), "PROJECT_REQUIRED").when(created_at.isNotNull() & F.try_to_timestamp(created_at).isNull(), "TIMESTAMP_INVALID")
    )
