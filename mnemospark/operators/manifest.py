"""What an incremental compile does, whether a set of notes can be indexed, and which note an identity names."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.text import single_spaced
from mnemospark.operators.graph import checkpointed, stored_round
from mnemospark.session import shared_folder


def chunk_actions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, chunk_index, action (ADD, UPDATE, KEEP) of every chunk of the current notes. Both sides have
    path and chunks (an array of hashes); stored chunks that lie beyond the current ones are just dropped."""
    c = current.select("path", F.posexplode("chunks").alias("chunk_index", "_new"))
    p = previous.select("path", F.posexplode("chunks").alias("chunk_index", "_old"))
    action = F.when(F.col("_old").isNull(), "ADD").when(F.col("_old") == F.col("_new"), "KEEP").otherwise("UPDATE")
    return c.join(p, ["path", "chunk_index"], "left").select("path", "chunk_index", action.alias("action"))


def edge_actions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, edge_id, action (ADD, KEEP, REMOVE) of the links of the notes on either side."""
    side = lambda df, mark: df.select("path", F.explode("edges").alias("edge_id")).distinct().withColumn(mark, F.lit(True))
    both = side(current, "_c").join(side(previous, "_p"), ["path", "edge_id"], "full_outer")
    return both.select("path", "edge_id", F.when(F.col("_p").isNull(), "ADD").when(F.col("_c").isNull(), "REMOVE").otherwise("KEEP").alias("action"))


def plan_fingerprint(plan: DataFrame) -> DataFrame:
    """One row: rows and fingerprint of a plan, whatever the order of its rows: sums of two hashes of each."""
    row = F.to_json(F.struct(*sorted(plan.columns)))
    sums = [F.sum(F.xxhash64(row, F.lit(i)).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    return plan.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("fingerprint"))


def compared(previous: Column, current: Column) -> Column:
    """How a value did since the last snapshot: not_compared without a current one, missing_previous without
    an earlier one, else unchanged or changed."""
    return F.when(current.isNull(), "not_compared").when(previous.isNull(), "missing_previous").when(previous == current, "unchanged").otherwise("changed")


def change_report(df: DataFrame, values: dict[str, tuple[str, str]], sets: dict[str, tuple[str, str]]) -> DataFrame:
    """df with the state of each component, any_changed and requires_refresh. values and sets name the
    previous and the current column of each component; sets compare without order and repeats."""
    plain = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    states = {k: compared(F.col(a), F.col(b)) for k, (a, b) in values.items()} | {k: compared(plain(a), plain(b)) for k, (a, b) in sets.items()}
    out = df.select("*", *[c.alias(k) for k, c in states.items()])
    has = lambda *words: reduce(lambda a, b: a | b, [F.col(k).isin(*words) for k in states])
    return out.withColumn("any_changed", has("changed")).withColumn("requires_refresh", has("changed", "missing_previous"))


# -- manifests ---------------------------------------------------------------------------------------


def _jumped(links: DataFrame) -> DataFrame:
    """id, next after two steps."""
    far = links.select(F.col("id").alias("_m"), F.col("next").alias("_n"))
    return links.join(far, links["next"] == far["_m"], "left").select("id", F.col("_n").alias("next"))


def on_cycles(links: DataFrame) -> DataFrame:
    """The ids on cycles of links (id, next), where an id has one next at most. Steps double each round, until
    the ids that some id stands on are no fewer than after half the steps: those steps then lead from each of them
    to another of them, so all are on cycles."""
    folder, far, n = f"{shared_folder(links.sparkSession)}/cycles-{uuid.uuid4().hex}", links, 0
    reached, before = far.select("next").distinct().count(), -1
    while reached and reached != before:
        far, n, before = stored_round(_jumped(far).where("next is not null"), folder, n + 1), n + 1, reached
        reached = far.select("next").distinct().count()
    return far.select(F.col("next").alias("id")).distinct()


def validate_manifest(candidates: DataFrame) -> DataFrame:
    """ordinal, code, detail of every candidate; a null code is accepted.

    candidates: ordinal (their order, without ties), note_id, relative_path, canonical_path, is_context,
    identity, supersedes, superseded_by. Paths that several notes have are rejected for all of them; of notes
    with one id, then of contexts with one identity, the first stays. What a context supersedes must be
    a context that stays, have no other replacement before it, and point back if it points anywhere; a
    replacement must point back; supersession has no cycle; and what supersedes a rejected context is
    rejected with it. Chains are followed by doubling steps, never one job a link."""
    first = lambda kept, *by: F.first(F.when(kept, F.struct("ordinal", "relative_path")), ignorenulls=True).over(Window.partitionBy(*by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    many = candidates.groupBy("canonical_path").agg((F.count(F.lit(1)) > 1).alias("_many"))
    rows = candidates.join(many, "canonical_path").withColumn("_f", first(~F.col("_many"), "note_id"))
    alone = ~F.col("_many") & (F.col("_f.ordinal") == F.col("ordinal"))
    rows = rows.withColumn("_g", F.when(F.col("is_context"), first(alone, "is_context", "identity")))
    code = F.when(F.col("_many"), "DUPLICATE_CANONICAL_PATH").when(F.col("_f.ordinal") != F.col("ordinal"), "DUPLICATE_CONTEXT_ID").when(F.col("is_context") & (F.col("_g.ordinal") != F.col("ordinal")), "DUPLICATE_CONTEXT_CONTENT")
    detail = F.when(F.col("_many"), F.col("canonical_path")).when(F.col("_f.ordinal") != F.col("ordinal"), F.col("_f.relative_path")).otherwise(F.col("_g.relative_path"))
    stays = alone & (~F.col("is_context") | (F.col("_g.ordinal") == F.col("ordinal")))
    judged = checkpointed(rows.select("ordinal", "note_id", "is_context", "supersedes", "superseded_by", code.alias("code"), F.when(code.isNotNull(), detail).alias("detail"), stays.alias("_stays")))
    repeated, valid = judged.where("code is not null").select("ordinal", "code", "detail"), judged.where("_stays")

    ctx = valid.where("is_context").select("ordinal", "note_id", "supersedes", "superseded_by")
    target = ctx.select(F.col("note_id").alias("supersedes"), F.col("superseded_by").alias("_back"), F.lit(True).alias("_target"))
    replacement = ctx.select(F.col("note_id").alias("superseded_by"), F.col("supersedes").alias("_forth"), F.lit(True).alias("_there"))
    c = ctx.join(target, "supersedes", "left").join(replacement, "superseded_by", "left")
    c = c.withColumn("_fits", F.coalesce("_target", F.lit(False)) & (F.col("_back").isNull() | (F.col("_back") == F.col("note_id"))))
    takers = c.where("_fits").groupBy("supersedes").agg(F.min(F.struct("ordinal", "note_id")).alias("_taker"))
    c = c.join(takers, "supersedes", "left")
    wrong = F.when(F.col("supersedes").isNotNull(), F.when(F.col("_target").isNull(), F.concat(F.lit("absent:"), "supersedes")).when(F.col("_taker.ordinal") < F.col("ordinal"), F.concat(F.lit("replaced:"), "_taker.note_id")).when(~F.col("_fits"), F.concat(F.lit("backlink:"), "_back")))
    back = F.when(F.col("superseded_by").isNotNull(), F.when(F.col("_there").isNull(), F.concat(F.lit("no_replacement:"), "superseded_by")).when(~F.col("_forth").eqNullSafe(F.col("note_id")), F.concat(F.lit("not_reciprocal:"), "superseded_by")))
    links = checkpointed(ctx.join(ctx.select(F.col("note_id").alias("supersedes")), "supersedes", "left_semi").select(F.col("note_id").alias("id"), F.col("supersedes").alias("next")))
    loops = on_cycles(links).select(F.col("id").alias("note_id"), F.lit("cycle").alias("_loop"))
    state = checkpointed(c.select("ordinal", "note_id", "supersedes", F.coalesce(wrong, back).alias("_why")).join(loops, "note_id", "left").select("ordinal", "note_id", "supersedes", F.coalesce("_loop", "_why").alias("why")))
    # what leads to a rejected context: each round looks twice as far along the chain; who has met one stops
    known = state.select(F.col("note_id").alias("id"), F.col("why").isNotNull().alias("bad"))
    folder, n = f"{shared_folder(state.sparkSession)}/chains-{uuid.uuid4().hex}", 0
    far = stored_round(known.join(links, "id", "left").select("id", "bad", F.when(~F.col("bad"), F.col("next")).alias("next")), folder, n)
    while not far.where("next is not null").isEmpty():
        ahead = far.select(F.col("id").alias("_m"), F.col("next").alias("_n"), F.col("bad").alias("_b"))
        met = F.col("bad") | F.coalesce("_b", F.lit(False))
        far, n = stored_round(far.join(ahead, far["next"] == ahead["_m"], "left").select("id", met.alias("bad"), F.when(~met, F.col("_n")).alias("next")), folder, n + 1), n + 1
    rejected = state.join(far.select(F.col("id").alias("note_id"), "bad"), "note_id")
    why = F.coalesce("why", F.when(F.col("bad"), F.concat(F.lit("absent:"), "supersedes")))
    broken = rejected.select("ordinal", F.when(why.isNotNull(), "INVALID_SUPERSEDE").alias("code"), why.alias("detail"))
    accepted = valid.where("not is_context").select("ordinal", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("detail"))
    return repeated.unionByName(broken).unionByName(accepted)


# -- identities --------------------------------------------------------------------------------------


def resolve_identity(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """request, resolution, note_id, path of each request (request, project, report, date, entity, edition).

    notes: note_id, path, project, report, aliases (of the report), date, entity, edition. One note with
    all five is EXISTING_CANONICAL_FAMILY; several are AMBIGUOUS_CANONICAL_IDENTITY; none is
    NEW_CANONICAL_IDENTITY. A new path is that of the latest earlier sibling (one project, report and
    entity), where that is one note, with its date exchanged; else project/report/date-entity.md."""
    flat = lambda c: F.lower(single_spaced(c))
    named = notes.withColumn("_r", F.explode(F.array_distinct(F.transform(F.concat(F.array("report"), F.coalesce("aliases", F.array().cast("array<string>"))), flat))))
    family = named.select(flat(F.col("project")).alias("_p"), "_r", flat(F.col("entity")).alias("_e"), F.col("date").alias("_d"), F.coalesce(flat(F.col("edition")), F.lit("")).alias("_ed"), "note_id", "path")
    asked = requests.withColumn("_p", flat(F.col("project"))).withColumn("_r", flat(F.col("report"))).withColumn("_e", flat(F.col("entity"))).withColumn("_ed", F.coalesce(flat(F.col("edition")), F.lit("")))
    same = family.groupBy("_p", "_r", "_e", "_d", "_ed").agg(F.countDistinct("note_id").alias("_n"), F.min("note_id").alias("note_id"), F.min_by("path", "note_id").alias("_path"))
    found = asked.join(same.withColumnRenamed("_d", "date"), ["_p", "_r", "_e", "_ed", "date"], "left")
    # of each family the notes of one date are a row; a request sees the last such row before its date
    dated = family.groupBy("_p", "_r", "_e", "_d").agg(F.countDistinct("note_id").alias("_same"), F.min_by("path", "note_id").alias("path"))
    dated = dated.select("_p", "_r", "_e", F.col("_d").alias("_at"), F.lit(1).alias("_late"), F.struct("path", "_d", "_same").alias("_s"))
    line = dated.withColumn("request", F.lit(None).cast(dict(requests.dtypes)["request"])).unionByName(asked.where("date is not null").select("_p", "_r", "_e", F.col("date").alias("_at"), F.lit(0).alias("_late"), F.lit(None).cast(dated.schema["_s"].dataType).alias("_s"), "request"))
    before = Window.partitionBy("_p", "_r", "_e").orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = line.withColumn("_s", F.last("_s", ignorenulls=True).over(before)).where("_late = 0 and _s is not null").select("request", "_s").dropDuplicates(["request"])
    rows = found.join(latest, "request", "left")
    fresh = F.concat(F.concat_ws("/", "project", "report", F.concat_ws("-", "date", "entity")), F.lit(".md"))
    moved = F.when((F.col("_s._same") == 1) & F.col("_s.path").contains(F.col("_s._d")), F.replace(F.col("_s.path"), F.col("_s._d"), F.col("date")))
    resolution = F.when(F.col("_n") == 1, "EXISTING_CANONICAL_FAMILY").when(F.col("_n") > 1, "AMBIGUOUS_CANONICAL_IDENTITY").otherwise("NEW_CANONICAL_IDENTITY")
    return rows.select("request", resolution.alias("resolution"), F.when(F.col("_n") == 1, F.col("note_id")).alias("note_id"), F.when(F.col("_n") == 1, F.col("_path")).otherwise(F.coalesce(moved, fresh)).alias("path"))
