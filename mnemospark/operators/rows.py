"""Best rows, duplicates, differences and other relational steps the engine is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators.graph import checkpointed


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; later equals lose. One row of the order's
    columns is kept per key while rows stream in, so a key with very many rows is no burden."""
    names = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_r = 1").select(*keys, *names)


def duplicate_groups(df: DataFrame, digest: str, member: str) -> DataFrame:
    """Digests that several members share: smallest member and how many. Sums only, no lists: a
    group may hold a third of the rows."""
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(member).alias("first_member"), F.count(F.lit(1)).alias("members")).where("members > 1")


def duplicate_members(df: DataFrame, digest: str, member: str) -> DataFrame:
    """digest, place (from 1, by member), member of the groups of duplicate_groups(), as rows: a group may hold a third
    of them. Places are running numbers over ranges of (digest, member) less what comes before the group, so no
    group is sorted by one task. Repeated members of a digest are one."""
    one = df.where(F.col(digest).isNotNull() & F.col(member).isNotNull()).select(digest, member).distinct()
    sizes = one.groupBy(digest).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    before = with_running_sum(sizes, [digest], "_size", "_sum").select(digest, (F.col("_sum") - F.col("_size")).alias("_before"))
    rows = one.join(before, digest).withColumn("_one", F.lit(1))
    return with_running_sum(rows, [digest, member], "_one", "_n").select(digest, (F.col("_n") - F.col("_before")).cast("long").alias("place"), member)


def snapshot_diff(current: DataFrame, previous: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, removed, updated) between two snapshots; unchanged keys are left out."""
    c, p = current.select(key, F.col(digest).alias("_new")), previous.select(key, F.col(digest).alias("_old"))
    both = c.withColumn("_c", F.lit(True)).join(p.withColumn("_p", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(~F.col("_new").eqNullSafe(F.col("_old")), "updated")
    return both.select(key, change.alias("change")).where("change is not null")


def compile_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """What an incremental compile does with each path. Both sides have path, source_hash,
    fingerprint and chunks (an array of chunk hashes; null or empty where none are stored)."""
    c = current.select("path", F.col("source_hash").alias("h"), F.col("fingerprint").alias("f"), F.coalesce("chunks", F.array().cast("array<string>")).alias("k"))
    p = previous.select("path", F.col("source_hash").alias("oh"), F.col("fingerprint").alias("of"), F.coalesce("chunks", F.array().cast("array<string>")).alias("ok"))
    both = c.join(p, "path", "full_outer")
    changed = F.exists(F.transform("k", lambda x, i: ~x.eqNullSafe(F.get("ok", i))), lambda x: x)  # vanished trailing chunks don't count
    same = F.col("h") == F.col("oh")
    action = F.when(F.col("h").isNull(), "REMOVED").when(F.col("oh").isNull(), "ADDED").when(same & ((F.size("ok") == 0) | (F.col("f") != F.col("of"))), "EMBEDDING_ONLY").when(~same, "UPDATED")
    reason = (
        F.when(F.col("h").isNull(), "REMOVE").when(F.col("oh").isNull(), "DOCUMENT_ADDED").when(same & (F.size("ok") == 0), "CHUNKS_CHANGED")
        .when(same & (F.col("f") != F.col("of")), "EMBEDDING_POLICY_CHANGED").when(~same & changed, "CHUNKS_CHANGED").otherwise("NONE")
    )
    return both.select("path", action.alias("action"), reason.alias("embedding")).where("action is not null")


def overlapping_pairs(df: DataFrame, block: str, key: str, start: str, end: str) -> DataFrame:
    """Pairs of one block whose closed intervals overlap (null ends are open), smaller key left.

    Two intervals overlap where one begins within the other. So each row has one place, the stretch of
    days its start lies in, and meets the rows of its block that span this stretch: only one side is
    dealt to all its stretches, and no pair is made twice. A stretch is as long as the mean interval,
    so that a row is in about two; a large block is spread over its stretches. The intervals are stored
    once: their bounds, their mean and both sides are read from there."""
    df = checkpointed(df.select(block, key, start, end))
    time = lambda c: F.col(c).cast("timestamp")
    low, high = F.least(F.min(time(start)), F.min(time(end))), F.greatest(F.max(time(start)), F.max(time(end)))
    bounds = df.groupBy(block).agg(low.alias("_lo"), high.alias("_hi"))
    rows = df.join(bounds, block).select(block, key, F.coalesce(time(start), "_lo").alias("_s"), F.coalesce(time(end), "_hi").alias("_e")).where("_s <= _e")
    mean = rows.agg(F.avg(F.datediff("_e", "_s"))).first()[0]
    stretch = lambda c: F.expr(f"unix_date(cast({c} as date)) div {max(int(mean or 0), 1)}")
    x = rows.select(block, F.col(key).alias("_x"), F.col("_s").alias("_xs"), F.col("_e").alias("_xe"), F.explode(F.sequence(stretch("_s"), stretch("_e"))).alias("_d"))
    y = rows.select(block, F.col(key).alias("_y"), F.col("_s").alias("_ys"), stretch("_s").alias("_d"))
    later = (F.col("_xs") < F.col("_ys")) | ((F.col("_xs") == F.col("_ys")) & (F.col("_x") < F.col("_y")))
    met = x.join(y, [block, "_d"]).where(later & (F.col("_ys") <= F.col("_xe")))
    return met.select(block, F.least("_x", "_y").alias("left_id"), F.greatest("_x", "_y").alias("right_id"))


def with_running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over all rows up to and with this one, in an order without ties.
    Ranges of the order are summed each by itself; what comes before a range is a row for each range."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    bases = ranged.groupBy("_part").agg(F.sum(value).alias("_t")).select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.sum(value).over(within)).drop("_part", "_base")


def source_set_hash(df: DataFrame, key: str, refs: list[str]) -> DataFrame:
    """A hash of each key's set of references: their hashes in order, hashed again."""
    one = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in refs]), 256)
    distinct = df.select(key, one.alias("_h")).distinct()
    return distinct.groupBy(key).agg(F.count(F.lit(1)).alias("sources"), F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), "|"), 256).alias("source_set_hash"))


def move_plan(moves: DataFrame, inventory: DataFrame, order: str) -> DataFrame:
    """moves (order, source, destination, reason) with state: ready, or the first reason why a move is not
    safe. inventory has the paths that exist and is_file. Of the moves that name one source, then of
    those left that name one destination, the first in order may go."""
    have = inventory.groupBy("path").agg(F.max("is_file").alias("is_file"))
    m = moves.join(have.select(F.col("path").alias("source"), F.lit(True).alias("_from"), F.col("is_file").alias("_file")), "source", "left")
    m = m.join(have.select(F.col("path").alias("destination"), F.lit(True).alias("_to")), "destination", "left")
    note = lambda c: F.col(c).rlike(r"[^/]\.md$")
    unsafe = (
        F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "reason_required").when(F.col("source") == F.col("destination"), "source_equals_destination")
        .when(~note("source") | ~note("destination"), "only_markdown_notes_can_be_moved").when(F.col("_from").isNull(), "source_missing")
        .when(~F.col("_file"), "source_not_file").when(F.col("_to"), "destination_exists")
    )
    m = m.withColumn("_u", unsafe)
    nth = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(order))
    m = m.withColumn("_i", F.when(F.col("_u").isNull(), nth("source", "_u")))
    m = m.withColumn("_j", F.when(F.col("_i") == 1, nth("destination", "_i")))
    state = F.coalesce("_u", F.when(F.col("_i") > 1, "duplicate_source").when(F.col("_j") > 1, "duplicate_destination").otherwise("ready"))
    return m.select(*moves.columns, state.alias("state"))


def move_status(planned: DataFrame) -> DataFrame:
    """One row: status of a plan: empty without moves, blocked where one is not ready, else ready."""
    ready, n = F.count_if(F.col("state") == "ready"), F.count(F.lit(1))
    return planned.agg(F.when(n == 0, "empty").when(ready < n, "blocked").otherwise("ready").alias("status"), n.alias("moves"), ready.alias("ready"))
