"""Checks of memories before they are kept: headings that a kind needs, secrets, a score, a status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import stripped

#: Second-level headings that each kind of memory needs (fixed values).
REQUIRED = {
    "HANDOFF": ["Summary", "Current State", "Next Actions", "Restore Prompt"],
    "COMPACT": ["Summary", "Current State", "Next Actions", "Restore Prompt"],
    "DECISION": ["Summary", "Key Decisions", "Evidence"],
    "BUG_ROOT_CAUSE": ["Summary", "Current State", "Evidence"],
    "PLAN": ["Summary", "Current State", "Next Actions"],
    "RESEARCH": ["Summary", "Evidence"],
    "USAGE": ["Summary", "Evidence"],
    "MEMORY": ["Summary", "Restore Prompt"],
}

#: What counts as a secret, in the order in which they are taken out. Java and RE2 read them alike.
SECRETS = {
    "cloud_key": r"AKIA[0-9A-Z]{16}",
    "host_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "service_key": r"sk-[A-Za-z0-9_-]{16,}",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}",
    "assignment": r"""(?i)(?:password|passwd|secret|api[_-]?key|access[_-]?token)[ \t]*[:=][ \t]*[^ \t\r\n"',;\[]+""",
}
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
MASK = "[REDACTED]"


def redacted(df: DataFrame, text: str) -> DataFrame:
    """df with redacted_text, n_redacted, secret_kinds (array of the kinds found) and blocked (a
    private key is in the text, which then must not be kept at all). A null text is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("redacted_text", t).withColumn("blocked", t.rlike(PRIVATE_KEY))
    for kind, pattern in SECRETS.items():  # each in a step of its own: a mask is no secret for the next
        df = df.withColumn(f"_{kind}", F.regexp_count("redacted_text", F.lit(pattern)))
        df = df.withColumn("redacted_text", F.when(F.col(f"_{kind}") > 0, F.regexp_replace("redacted_text", pattern, MASK)).otherwise(F.col("redacted_text")))
    counts = [F.col(f"_{k}") for k in SECRETS]
    kinds = F.array_compact(F.array(*[F.when(F.col(f"_{k}") > 0, k) for k in SECRETS]))
    return df.withColumn("n_redacted", sum(counts, F.lit(0))).withColumn("secret_kinds", kinds).drop(*[f"_{k}" for k in SECRETS])


def headings(text: Column) -> Column:
    """The second-level headings of a Markdown text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^##\s+([^\n]+)"), F.lit(1)), lambda h: stripped(h))


def lint(df: DataFrame, kind: str, title: str, content: str, summary: str) -> DataFrame:
    """df with n_errors, n_warnings, score (100, less 40 an error and 8 a warning, at least 0), status
    and what redacted() adds. Errors: no title, no content, a private key. Warnings: no summary, each
    heading that the kind lacks, each kind of secret. An unknown kind needs no headings."""
    empty = lambda c: (stripped(F.coalesce(F.col(c), F.lit(""))) == "").cast("int")
    rules = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    needed = F.coalesce(rules[F.col(kind)], F.array().cast("array<string>"))
    missing = F.size(F.array_except(needed, headings(F.coalesce(F.col(content), F.lit("")))))
    rows = redacted(df, content)
    rows = rows.withColumn("n_errors", empty(title) + empty(content) + F.col("blocked").cast("int"))
    rows = rows.withColumn("n_warnings", empty(summary) + missing + F.when(F.col("blocked"), 0).otherwise(F.size("secret_kinds")))
    rows = rows.withColumn("score", F.greatest(100 - 40 * F.col("n_errors") - 8 * F.col("n_warnings"), F.lit(0)))
    status = (
        F.when(F.col("blocked"), "BLOCKED_SECRET_RISK")
        .when(F.col("score") < 70, "PENDING_REVIEW")
        .when(F.col("n_redacted") > 0, "REDACTED_AND_SAVED")
        .when(F.col("n_warnings") > 0, "SAVED_WITH_WARNINGS")
        .otherwise("SAVED")
    )
    return rows.withColumn("status", status)


#: Names of fields that hold secrets, and those that only say whether there are any (fixed values).
SECRET_FIELD, AUDIT_FIELDS = r"(?i)(password|passwd|secret|token|api[_-]?key|credential|private[_-]?key)", {"secret_values_recorded"}


def redacted_json(value: Column) -> Column:
    """A JSON object without its secret fields, at any depth, and with secrets in its texts masked; null for
    what is no JSON and where a private key is in it. Keys keep their order."""

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        import json
        import re

        patterns = [re.compile(p) for p in SECRETS.values()]
        field, private = re.compile(SECRET_FIELD), re.compile(PRIVATE_KEY)

        def walk(x):
            if isinstance(x, dict):
                return {k: walk(v) for k, v in x.items() if not field.search(k) or (k in AUDIT_FIELDS and v is False)}
            if isinstance(x, list):
                return [walk(v) for v in x]
            if isinstance(x, str):
                for p in patterns:
                    x = p.sub(MASK, x)
            return x

        def one(raw):
            try:
                return None if raw is None or private.search(raw) else json.dumps(walk(json.loads(raw)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return values.map(one)

    return clean(value)


#: Metadata fields that are lists, and those that are true or false (fixed values).
LIST_FIELDS, BOOLEAN_FIELDS, URL_FIELDS = ["tags", "aliases", "source_refs"], ["done", "archived", "pinned"], ["url", "source_url"]


def integrity(entries: DataFrame) -> DataFrame:
    """note_id, field, value, code of the metadata entries (note_id, field, kind, value) that are not what
    their field asks for."""
    field, kind, value = F.col("field"), F.col("kind"), F.col("value")
    code = (
        F.when(field.isin(LIST_FIELDS) & (kind == "string") & F.trim(value).rlike(r"(?s)^(\(.*\)|\[.*\]|\{.*\})$"), "LEGACY_COLLECTION").when(field.isin(LIST_FIELDS) & ~kind.isin("list", "string", "null"), "WRONG_COLLECTION_TYPE")
        .when(field.isin(BOOLEAN_FIELDS) & (kind != "boolean") & ~F.lower(F.trim(value)).isin("true", "false"), "WRONG_BOOLEAN_TYPE").when((kind == "string") & (F.trim(value) == ""), "EMPTY_SCALAR")
        .when(field.isin(URL_FIELDS) & ~value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"), "UNRECOVERABLE_URL")
    )
    return entries.withColumn("code", code).where("code is not null").select("note_id", "field", "value", "code")


def replacement(code: Column, value: Column) -> Column:
    """The JSON that repairs a finding; null where nobody can tell."""
    inner = F.regexp_replace(F.trim(value), r"^[(\[{]|[)\]}]$", "")
    items = F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")
    return F.when(code == "LEGACY_COLLECTION", F.to_json(items)).when(code == "WRONG_COLLECTION_TYPE", F.to_json(F.array(F.trim(value))))


def repair_plan(found: DataFrame) -> DataFrame:
    """note_id, repairs, plan_hash: what can be repaired in each note, and a hash that tells one plan from
    another. A note has as many rows as it has fields."""
    rows = found.withColumn("new", replacement(F.col("code"), F.col("value"))).where("new is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("field", "new"))), lambda x: F.concat_ws("=", x["field"], x["new"]))
    return rows.groupBy("note_id").agg(F.count(F.lit(1)).alias("repairs"), F.sha2(F.array_join(lines, "\n"), 256).alias("plan_hash"))
