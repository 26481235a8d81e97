"""Briefs: the recalled contexts of each query, within budgets of bytes and records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections that come first, by words in their headings (fixed values).
CORE = [("goal", "objective"), ("constraint",), ("unconfirmed", "uncertain", "open question"), ("next action", "next step")]
#: Entries that a brief considers: as many as a context pack has.
CONSIDERED = 10


def cut_to_bytes(text: str, most: int) -> str:
    """The longest beginning of a text that has most bytes at most."""
    return text if len(text.encode()) <= most else text.encode()[: max(most, 0)].decode(errors="ignore")


def sections(content: str) -> list[tuple[str, str]]:
    """Headings and texts of a Markdown content, core ones first, the others as they stand."""
    parts, at, head = [], 0, ""
    for m in re.finditer(r"^#{1,6}[ \t]+(.+)$", content, re.M):
        parts.append((head, content[at : m.start()].strip()))
        head, at = m[1].strip(), m.end()
    parts.append((head, content[at:].strip()))
    rank = lambda h: next((i for i, words in enumerate(CORE) if any(w in h.lower() for w in words)), len(CORE))
    return sorted([p for p in parts if p[0] or p[1]], key=lambda p: rank(p[0]))


def brief(matches: DataFrame, delivered: DataFrame, *, byte_budget: int, record_budget: int) -> DataFrame:
    """query, context, state, content, content_bytes, position for each of a query's best contexts.

    matches: query, context, content_hash, content, score, position; delivered: query, context,
    content_hash of what the reader has. state: already_delivered (the same hash, nothing sent), new or
    changed (sent, sections cut at the end of the budget), omitted_record_budget,
    omitted_byte_budget. A query's rows are the CONSIDERED best, so one task holds few."""
    from pyspark.sql.window import Window

    best = F.row_number().over(Window.partitionBy("query", "context").orderBy(F.desc("score"), "position"))
    one = matches.withColumn("_b", best).where("_b = 1")
    top = one.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "position", "context"))).where(F.col("_n") <= CONSIDERED)
    had = delivered.select("query", "context", F.col("content_hash").alias("_had")).dropDuplicates(["query", "context"])
    rows = top.join(had, ["query", "context"], "left").select("query", "context", "content_hash", "content", "_had", "_n")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        out, left, sent = [], byte_budget, 0
        for r in pdf.sort_values("_n").itertuples(index=False):
            had_hash = r[4] if isinstance(r[4], str) else None
            if had_hash == r.content_hash:
                out.append((r.query, r.context, "already_delivered", "", 0, int(r[5])))
                continue
            if sent >= record_budget or left <= 0:
                out.append((r.query, r.context, "omitted_record_budget" if sent >= record_budget else "omitted_byte_budget", "", 0, int(r[5])))
                continue
            text = "\n".join((f"#### {h}\n" if h else "") + t for h, t in sections(r.content or ""))
            text = cut_to_bytes(text, left)
            left, sent = left - len(text.encode()), sent + 1
            out.append((r.query, r.context, "changed" if had_hash else "new", text, len(text.encode()), int(r[5])))
        return pd.DataFrame(out, columns=["query", "context", "state", "content", "content_bytes", "position"])

    kinds = dict(matches.dtypes)
    return rows.groupBy("query").applyInPandas(fill, f"query {kinds['query']}, context {kinds['context']}, state string, content string, content_bytes int, position int")
