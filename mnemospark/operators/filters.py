"""Predicates and row selections: scopes, lifecycle, tags, time, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Requested lifecycle values and the stored ones they stand for (fixed values).
LIFECYCLE = {"CURRENT": ("current", "saved", "active"), "ACTIVE": ("current", "saved", "active"), "DRAFT": ("draft",), "ARCHIVED": ("archived",), "SUPERSEDED": ("superseded",)}


def all_of(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every wanted value that isn't None; a pair is an inclusive range."""
    for name, value in wanted.items():
        if isinstance(value, tuple):
            low, high = value
            df = df.where(F.col(name) >= low) if low is not None else df
            df = df.where(F.col(name) <= high) if high is not None else df
        elif isinstance(value, list):
            df = df.where(F.col(name).isin(value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def has_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0 if wanted else F.lit(True)


def in_scopes(scope: Column, identities: dict[str, tuple[Column, object]]) -> Column:
    """Any of the requested scopes with its identity; a scope without identity (None) needs none."""
    tests = [(scope == name) if value is None else (scope == name) & (column == value) for name, (column, value) in identities.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def in_workspace(workspace: Column, wanted: str | None) -> Column:
    """Rows of the wanted workspace; without one, those of before there were any (null or empty)."""
    return F.coalesce(workspace == wanted, F.lit(False)) if wanted is not None else F.coalesce(workspace, F.lit("")) == ""


def visible(index_status: Column, status: Column, path: Column, wanted: list[str]) -> Column:
    """Indexed rows whose lifecycle status (active where empty) is wanted, outside the operations folder."""
    values = sorted({v for w in wanted for v in LIFECYCLE[w]})
    state = F.coalesce(F.nullif(F.lower(F.trim(status)), F.lit("")), F.lit("active"))
    return (index_status == "indexed") & state.isin(values) & ~path.startswith("_Ops/")


def containing(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows where one of the columns has needle in it, in any case; upper case first, so that a sharp s
    is ss as well."""
    flat = lambda c: F.lower(F.upper(c))
    return df.where(flat(F.concat_ws("\n", *columns)).contains(flat(F.lit(needle))))


def note_filter(*, types=(), not_types=(), statuses=(), not_statuses=(), not_prefixes=(), project: str | None = None, tags=()) -> Column:
    """What a search keeps of notes (note_type, status, relative_path, project, tags): each given filter
    must hold, none given keeps all. An empty status counts as active where statuses are asked for."""
    flat = lambda values: [v.strip().lower() for v in values]
    state = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("active"))
    tests = [F.col("note_type").isin(list(types))] if types else []
    tests += [~F.col("note_type").isin(list(not_types))] if not_types else []
    tests += [state.isin(flat(statuses))] if statuses else []
    tests += [~F.lower("status").isin(flat(not_statuses))] if not_statuses else []
    tests += [~F.col("relative_path").startswith(p) for p in not_prefixes]
    tests += [F.col("project") == project] if project is not None else []
    tests += [has_tags(F.col("tags"), list(tags))] if tags else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def valid_at(df: DataFrame, moment: Column, start: str, end: str) -> DataFrame:
    """Rows whose closed interval holds moment; an open end is null."""
    return df.where((F.col(start).isNull() | (F.col(start) <= moment)) & (F.col(end).isNull() | (F.col(end) >= moment)))


def recalled(view: str, at: Column) -> Column:
    """Whether a memory is in the view at a moment: ALL, HISTORICAL (valid then) or CURRENT (valid,
    not archived, neither ended nor superseded). Columns: created_at, is_archived, valid_from,
    valid_to, superseded_by. One without any of the last three is valid from its creation."""
    if view == "ALL":
        return F.lit(True)
    start, end, by = F.col("valid_from"), F.col("valid_to"), F.col("superseded_by")
    known = start.isNotNull() | end.isNotNull() | by.isNotNull()
    valid = F.when(known, (start.isNull() | (start <= at)) & (end.isNull() | (at <= end))).otherwise(F.col("created_at") <= at)
    if view == "HISTORICAL":
        return valid
    return ~F.coalesce("is_archived", F.lit(False)) & valid & end.isNull() & by.isNull()


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next size rows after a cursor and next_cursor: the key to go on from, null on the last page."""
    rows = (df.where(F.col(key) > after) if after is not None else df).orderBy(key).limit(size + 1)
    last = rows.agg(F.sort_array(F.collect_list(key)).alias("k"))  # size + 1 keys at most
    cursor = last.select(F.when(F.size("k") > size, F.get("k", F.lit(size - 1))).alias("next_cursor"), F.get("k", F.lit(size)).alias("_stop"))
    return rows.join(F.broadcast(cursor)).where(F.col("_stop").isNull() | (F.col(key) < F.col("_stop"))).drop("_stop")
