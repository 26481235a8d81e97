"""Front matter kept as JSON, read as VARIANT: scope, aliases, contexts and what is wrong with them.

A text that is no JSON, or no object, reads as null in every field and has its code in error()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import single_spaced, stripped
from mnemospark.operators.records import SCOPES, STATUSES, effective_scope

#: Fields of a context's front matter by how they are read (fixed values).
TEXTS = ["project", "workspace_id", "agent_id", "user_id", "session_id", "source_actor_id", "source_run_id", "external_run_id", "supersedes_context_id", "superseded_by_context_id", "reconciliation_candidate_id"]
NAMES = ["source_actor_type", "confidence", "context_kind", "memory_function", "kind"]
LISTS = ["artifact_refs", "evidence_refs", "conflict_set_ids"]
TIMES = ["created_at", "updated_at", "recorded_at", "observed_at", "valid_from", "valid_to"]
#: Fields that may stand in provenance as well, where both must agree.
PROVENANCE = ["source_actor_id", "source_actor_type", "source_run_id", "external_run_id", "artifact_refs", "evidence_refs", "confidence"]


def parsed(front: Column) -> Column:
    """The object that a JSON text holds; null for anything else."""
    v = F.try_parse_json(front)
    return F.when(F.schema_of_variant(v).startswith("OBJECT<"), v)


def _kind(v: Column, path: str) -> Column:
    """What stands at a path: OBJECT<...>, ARRAY<...>, STRING, ...; null where nothing does, VOID for null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    """A scalar as text without white space around it; null for none, an empty one, an object or a list."""
    scalar = ~F.coalesce(_kind(v, path).rlike("^(OBJECT|ARRAY|VOID)"), F.lit(False))
    return F.nullif(F.when(scalar, stripped(F.try_variant_get(v, path, "string"))), F.lit(""))


def list_at(v: Column, path: str) -> Column:
    """A list of texts, each once, or a scalar as a list of one; empty where nothing stands."""
    none = F.array().cast("array<string>")
    raw = F.when(_kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<string>")).otherwise(F.array(text_at(v, path)))
    return F.array_distinct(F.filter(F.transform(F.coalesce(raw, none), stripped), lambda x: F.coalesce(x != "", F.lit(False))))


def time_at(v: Column, path: str) -> Column:
    """An instant; a date alone is its first one in UTC. Null where nothing stands or it can't be read."""
    raw = text_at(v, path)
    return F.try_to_timestamp(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(raw, F.lit("T00:00:00Z"))).otherwise(raw))


def scope_of(front: Column, kind: Column, project: Column) -> Column:
    """records.effective_scope() with the scope that front matter states."""
    return effective_scope(text_at(parsed(front), "$.scope"), kind, project)


def has_alias(front: Column, wanted: str) -> Column:
    """Any of the aliases (a scalar or a list) equals wanted, in any case, white space single."""
    fold = lambda c: F.lower(single_spaced(c))
    return F.exists(list_at(parsed(front), "$.aliases"), lambda a: fold(a) == fold(F.lit(wanted)))


def error(front: Column) -> Column:
    """The code of the first thing that is wrong with a context's front matter, with its field behind a colon;
    null where nothing is. Fields are looked at in the order of the lists above."""
    v = parsed(front)
    scope, status = F.upper(text_at(v, "$.scope")), F.lower(text_at(v, "$.status"))
    kind = lambda f: F.coalesce(_kind(v, f"$.{f}"), F.lit("VOID"))
    tests: list[tuple[Column, str]] = [
        (front.isNull() | F.try_parse_json(front).isNull(), "JSON_MALFORMED"), (v.isNull(), "JSON_NOT_AN_OBJECT"),
        (scope.isNull(), "SCOPE_REQUIRED"), (~scope.isin(SCOPES), "SCOPE_INVALID"), (status.isNotNull() & ~status.isin(STATUSES), "STATUS_INVALID"),
        ((scope == "PROJECT") & text_at(v, "$.project").isNull(), "PROJECT_REQUIRED"),
    ]
    tests += [(kind(f).rlike("^(OBJECT|ARRAY)"), f"TEXT_INVALID:{f}") for f in [*TEXTS, *NAMES]]
    tests += [(kind(f).startswith("OBJECT") | kind(f).rlike("^ARRAY<.*(OBJECT|ARRAY)"), f"LIST_INVALID:{f}") for f in LISTS]
    tests += [((kind(f) != "VOID") & (kind(f).rlike("^(OBJECT|ARRAY)") | (text_at(v, f"$.{f}").isNotNull() & time_at(v, f"$.{f}").isNull())), f"TIMESTAMP_INVALID:{f}") for f in TIMES]
    digest = text_at(v, "$.content_hash")
    tests.append((digest.isNotNull() & ~F.lower(digest).rlike("^[0-9a-f]{64}$"), "CONTENT_HASH_INVALID"))
    tests.append(((time_at(v, "$.valid_from") > time_at(v, "$.valid_to")), "VALIDITY_INVALID"))
    for f in PROVENANCE:
        nested = _kind(v, "$.provenance").startswith("OBJECT")
        if f in LISTS:
            own, other = list_at(v, f"$.{f}"), list_at(v, f"$.provenance.{f}")
            differ = (F.size(own) > 0) & (own != other)
        else:
            case = F.upper if f in NAMES else (lambda c: c)
            own, other = case(text_at(v, f"$.{f}")), case(text_at(v, f"$.provenance.{f}"))
            differ = own.isNotNull() & ~own.eqNullSafe(other)
        tests.append((nested & differ, f"PROVENANCE_CONFLICT:{f}"))
    first, *rest = tests
    return reduce(lambda c, t: c.when(F.coalesce(t[0], F.lit(False)), t[1]), rest, F.when(F.coalesce(first[0], F.lit(False)), first[1]))


def context(front: Column, note_id: Column, note_type: Column, indexed_at: Column) -> Column:
    """A note as a context: context_id, scope (stated, else by the identity at hand), status, kind (stated, else the
    note's type), the texts, names, lists and times of its front matter (flat ones before those of
    provenance), and metadata: a map of all other fields as JSON. created_at falls back to indexed_at, updated_at
    to created_at. Null where the front matter is no object."""
    v = parsed(front)
    flat = {f: F.coalesce(text_at(v, f"$.{f}"), text_at(v, f"$.provenance.{f}") if f in PROVENANCE else F.lit(None)) for f in TEXTS}
    named = {f: F.upper(F.coalesce(text_at(v, f"$.{f}"), text_at(v, f"$.provenance.{f}") if f in PROVENANCE else F.lit(None))) for f in NAMES if f != "kind"}
    lists = {}
    for f in LISTS:
        own = list_at(v, f"$.{f}")
        lists[f] = F.when(F.size(own) > 0, own).otherwise(list_at(v, f"$.provenance.{f}")) if f in PROVENANCE else own
    times = {f: time_at(v, f"$.{f}") for f in TIMES if f not in ("created_at", "updated_at")}
    created = F.coalesce(time_at(v, "$.created_at"), indexed_at)
    identity = F.when(flat["project"].isNotNull(), "PROJECT").when(flat["agent_id"].isNotNull(), "AGENT").when(flat["user_id"].isNotNull(), "USER").when(flat["session_id"].isNotNull(), "SESSION").otherwise("GLOBAL")
    known = [*TEXTS, *NAMES, *LISTS, *TIMES, "scope", "status", "content_hash", "provenance"]
    metadata = F.map_filter(F.try_variant_get(v, "$", "map<string,string>"), lambda k, x: ~k.isin(known))
    fields = {"context_id": F.concat(F.lit("note:"), note_id.cast("string")), "scope": F.coalesce(F.upper(text_at(v, "$.scope")), identity), "status": F.coalesce(F.lower(text_at(v, "$.status")), F.lit("active")),
              "kind": F.upper(F.coalesce(text_at(v, "$.kind"), note_type)), **flat, **named, **lists, **times, "created_at": created, "updated_at": F.coalesce(time_at(v, "$.updated_at"), created), "metadata": metadata}
    return F.when(v.isNotNull(), F.struct(*[c.alias(name) for name, c in fields.items()]))
