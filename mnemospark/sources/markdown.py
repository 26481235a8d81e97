"""A vault of Markdown notes as rows: scan, front matter, headings, chunks, links; and back to files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.rows import with_running_sum

INTEGER = re.compile(r"[+-]?(?:0|[1-9][0-9]*)\Z")
FLOAT = re.compile(r"[+-]?(?:0|[1-9][0-9]*)(?:\.[0-9]+|[eE][+-]?[0-9]+)\Z")
HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#*)?[ \t]*\Z")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
#: What is left out one after the other before links are looked for, and a link (fixed patterns).
HIDDEN = [re.compile(r"<!--.*?-->", re.S), re.compile(r"%%.*?%%", re.S), re.compile(r"(`+).*?\1", re.S)]
LINK = re.compile(r"(!?)\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]")
OPENING = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
SECTION = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def scan(spark: SparkSession, root: str, max_bytes: int | None = None, *, max_files: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """relative_path, size, modified_at, text, complete of the visible .md files under root. With limits
    only the files that fit, in path order: max_bytes in all, max_files, max_file_bytes each (larger ones
    are passed over unread); complete tells whether all did."""
    limits = [x for x in (max_bytes, max_files, max_file_bytes) if x is not None]
    if any(x <= 0 for x in limits):
        raise ValueError("limits of a scan must be positive")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")) + "/", "")
    rows = files.select(path.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.col("content").cast("string").alias("text"))
    rows = rows.where(~F.col("relative_path").rlike(r"(^|/)\."))
    if not limits:
        return rows.withColumn("complete", F.lit(True))
    sizes = rows.select("relative_path", "size", F.lit(1).alias("_one"))  # a row per file, without its text
    fits = sizes if max_file_bytes is None else sizes.where(F.col("size") <= max_file_bytes)
    for most, value in ((max_bytes, "size"), (max_files, "_one")):
        if most is not None:
            fits = with_running_sum(fits, ["relative_path"], value, "_sum").where(F.col("_sum") <= most).drop("_sum")
    complete = fits.count() == sizes.count()
    rows = rows if max_file_bytes is None else rows.where(F.col("size") <= max_file_bytes)
    return rows.join(fits.select("relative_path", F.lit(complete).alias("complete")), "relative_path")


def scalar(raw: str) -> tuple[str, str | None]:
    """Kind and value of a front-matter value. Numbers have no leading zeros, and either a fraction or an
    exponent; within single quotes two stand for one."""
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"":
        return "string", raw[1:-1].replace("''", "'") if raw[0] == "'" else raw[1:-1]
    if raw in ("", "~") or raw.lower() == "null":
        return "null", None
    if raw.lower() in ("true", "false"):
        return "boolean", raw.lower()
    if INTEGER.match(raw):
        return "integer", raw
    if FLOAT.match(raw):
        return "float", raw
    return "string", raw


def inline_items(raw: str) -> list[str]:
    """The items of [a, 'b, c', [d]]: commas within quotes and brackets don't count, and a quote after a
    backslash ends nothing. Items may be empty; a list of white space has none."""
    inner = raw[1:-1]
    if not inner.strip():
        return []
    items, quote, depth, begin, skip = [], "", 0, 0, False
    for i, c in enumerate(inner):
        if quote:
            quote = "" if c == quote and not skip else quote
            skip = c == "\\" and not skip
        elif c in "'\"":
            quote, skip = c, False
        elif c in "[{(":
            depth += 1
        elif c in "]})":
            depth = max(depth - 1, 0)
        elif c == "," and not depth:
            items.append(inner[begin:i].strip())
            begin = i + 1
    return [*items, inner[begin:].strip()]


def front_matter(lines: list[str]) -> list[dict] | None:
    """key, kind, values of the entries between the marks; None where a key stands twice.

    Only lines without indent open an entry. One without a value opens a list, whose items may be
    indented; any other line of an entry ends it. Empty lines and # lines are passed over."""
    entries: list[dict] = []
    open_: list | None = None
    for raw in lines:
        line, stripped = raw.rstrip("\r\n"), raw.strip()
        if not stripped or stripped.startswith("#"):
            continue
        if open_ is not None and stripped.startswith("-"):
            open_.append(scalar(stripped[1:])[1])
            continue
        if line != line.lstrip():
            continue
        open_ = None
        key, colon, value = (x.strip() for x in line.partition(":"))
        if not colon or not key:
            continue
        if any(e["key"] == key for e in entries):
            return None
        if value == "":
            open_ = []
            entries.append({"key": key, "kind": "list", "values": open_})
        elif value[0] == "[" and value[-1] == "]":
            entries.append({"key": key, "kind": "list", "values": [scalar(x)[1] for x in inline_items(value)]})
        else:
            kind, lexeme = scalar(value)
            entries.append({"key": key, "kind": kind, "values": [lexeme]})
    return entries


def analyse(text: str) -> dict:
    """Front matter (key, kind, values), body, headings (level, text, line) and error of a note. A front
    matter that isn't closed, or has a key twice, is an error: the note then has no entries."""
    lines = text.splitlines(keepends=True)
    entries: list[dict] = []
    error, body = None, text
    if lines and lines[0].strip() == "---":
        close = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        found = None if close is None else front_matter(lines[1:close])
        if found is None:
            error = "FRONTMATTER_PARSE_ERROR"
        else:
            entries, body = found, "".join(lines[close + 1 :])
    headings, fence = [], ""
    for i, raw in enumerate(body.splitlines(), 1):
        mark = FENCE.match(raw)
        if fence:
            fence = "" if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not raw.strip(" " + fence[0]) else fence
        elif mark:
            fence = mark[1]
        elif h := HEADING.match(raw):
            headings.append({"level": len(h[1]), "text": h[2].strip(), "line": i})
    return {"frontmatter": entries, "body": body, "headings": headings, "error": error}


def cut_points(text: str, most: int = 1400, overlap: int = 160) -> list[tuple[int, int]]:
    """Where a section is cut: at most `most` characters, ended where possible after a paragraph, a
    line, a sentence or a word in its second half, the next one beginning up to overlap before."""
    spans, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            for mark, width in (("\n\n", 2), ("\n", 1), (". ", 1), (" ", 1)):
                at = text.rfind(mark, start + most // 2, end)
                if at >= 0:
                    end = at + width
                    break
        spans.append((start, end))
        if end >= len(text):
            break
        nxt = max(start + 1, end - overlap)
        while nxt < end and not text[nxt - 1].isspace():
            nxt += 1
        start = nxt
    return spans


def byte_places(text: str, places: list[int]) -> dict[int, int]:
    """Where characters begin in the UTF-8 of a text, in one pass over it."""
    if text.isascii():
        return {p: p for p in places}
    out, last, size = {}, 0, 0
    for p in sorted(set(places)):
        size += len(text[last:p].encode("utf-8", "surrogatepass"))
        out[p], last = size, p
    return out


def with_ranges(found: list[dict], text: str, base: int) -> list[dict]:
    """found with start and end moved by base, and byte_start, byte_end: places in text, of which base
    characters stand before what was searched."""
    at = byte_places(text, [base + x[k] for x in found for k in ("start", "end")])
    return [{**x, "start": base + x["start"], "end": base + x["end"], "byte_start": at[base + x["start"]], "byte_end": at[base + x["end"]]} for x in found]


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """A range without white space at its ends."""
    part = text[a:b]
    return a + len(part) - len(part.lstrip()), a + max(len(part.rstrip()), len(part) - len(part.lstrip()))


def chunks(title: str, body: str, most: int = 1400, overlap: int = 160) -> list[dict]:
    """The chunks of a body: cut at headings, which stay with what follows, then by size; each with its path of
    headings and its range in body, so that body[start:end] is the content. What comes before the first
    heading has the title's name. A blank body has one chunk of the title, of kind title_fallback and
    without a range; pieces of white space alone are none."""
    a, b = _bare(body, 0, len(body))
    kind = "content"
    if a == b:
        body, kind = title, "title_fallback"
        a, b = _bare(body, 0, len(body))
    text = body[a:b]
    heads, path = list(SECTION.finditer(text)), []
    sections = [([title] if title else [], title, *((0, len(text)) if not heads else _bare(text, 0, heads[0].start())))]
    for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=False):
        path = [*path[: len(m[1]) - 1], m[2].strip()]
        sections.append((path, path[-1], *_bare(text, m.start(), end)))
    found: list[dict] = []
    for names, name, begin, end in sections:
        for s, e in cut_points(text[begin:end], most, overlap):
            s, e = _bare(text, begin + s, begin + e)
            if s < e:
                range_ = (a + s, a + e) if kind == "content" else (0, 0)
                found.append({"index": len(found), "heading": name, "heading_path": names, "content": text[s:e], "kind": kind, "start": range_[0], "end": range_[1]})
    return found


def links(body: str) -> list[dict]:
    """[[target#heading|alias]] outside code and comments, ! before it an embed; start and end are places in
    body, of which raw can leave out comments that stand within the link.

    Lines in fences (closed by a line of the same sign, as long at least) and indented ones go, then closed
    comments, then code within lines; what isn't closed hides nothing."""
    seen: list[str] = []
    origin: list[int] = []  # where each visible character stands
    fence, at = "", 0
    for line in body.splitlines(keepends=True):
        if fence:
            bare = line.strip()
            fence = "" if bare and set(bare) == {fence[0]} and len(bare) >= len(fence) else fence
            hide = True
        else:
            mark = OPENING.match(line)
            fence = mark[1] if mark else ""
            hide = bool(mark) or line.startswith(("\t", "    "))
        if not hide:
            seen.append(line)
            origin.extend(range(at, at + len(line)))
        elif line.endswith("\n"):
            seen.append("\n")
            origin.append(at + len(line) - 1)
        at += len(line)
    text = "".join(seen)
    for pattern in HIDDEN:
        parts, places, last = [], [], 0
        for m in pattern.finditer(text):
            parts.append(text[last : m.start()])
            places.extend(origin[last : m.start()])
            last = m.end()
        text, origin = "".join(parts) + text[last:], places + origin[last:]
    return [
        {"kind": "embed" if m[1] else "wikilink", "target": m[2].strip(), "heading": m[3], "alias": m[4], "raw": m[0], "start": origin[m.start()], "end": origin[m.end() - 1] + 1}
        for m in LINK.finditer(text)
    ]


ANALYSIS = "array<struct<key:string,kind:string,values:array<string>>>"
HEADINGS = "array<struct<level:int,text:string,line:int>>"
CHUNKS = "array<struct<index:int,heading:string,heading_path:array<string>,content:string,kind:string,start:int,end:int,byte_start:int,byte_end:int>>"
LINKS = "array<struct<kind:string,target:string,heading:string,alias:string,raw:string,start:int,end:int,byte_start:int,byte_end:int>>"


def notes(files: DataFrame, most: int = 1400, overlap: int = 160, keep: tuple[str, ...] = ()) -> DataFrame:
    """files (relative_path, text) with everything read from the text: front matter, body, headings,
    chunks, links, error and hashes. Ranges of chunks and links are places in the whole text, in characters
    and in bytes of its UTF-8. Null texts are empty; errors are a column, never an exception. Where files has a
    column error (of a bounded scan), rows with one keep it, with nothing read from them. keep: text columns of files
    that come along, so that nothing need be joined to have them."""
    failed = F.col("error") if "error" in files.columns else F.lit(None).cast("string")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text, failure in zip(f["relative_path"], f["text"], f["_failed"], strict=True):
                if failure is not None:
                    rows.append((path, None, [], None, [], [], [], failure))
                    continue
                text = text or ""
                a = analyse(text)
                base = len(text) - len(a["body"])
                title = next((e["values"][0] for e in a["frontmatter"] if e["key"] == "title" and e["values"] and e["values"][0]), None) or re.sub(r"\.md$", "", (path or "").rpartition("/")[2])
                rows.append((path, title, a["frontmatter"], a["body"], a["headings"], with_ranges(chunks(title, a["body"], most, overlap), text, base), with_ranges(links(a["body"]), text, base), a["error"]))
            yield pd.DataFrame(rows, columns=["relative_path", "title", "frontmatter", "body", "headings", "chunks", "links", "error"]).assign(**{c: f[c].to_numpy() for c in keep})

    schema = f"relative_path string, title string, frontmatter {ANALYSIS}, body string, headings {HEADINGS}, chunks {CHUNKS}, links {LINKS}, error string" + "".join(f", `{c}` string" for c in keep)
    return files.select("relative_path", "text", failed.alias("_failed"), *[c for c in keep if c not in ("relative_path", "text")]).mapInPandas(apply, schema).withColumn("content_hash", F.sha2("body", 256))


#: Texts that would be read as something else than themselves, or be cut (see scalar() and front_matter()).
AMBIGUOUS = r"""(?i)^$|^(~|null|true|false)$|^[+-]?(0|[1-9][0-9]*)(\.[0-9]+|e[+-]?[0-9]+)?$|^['"\[{#-]|^\s|\s$"""
LINE_ENDS = r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]+"


def _value(column, kind: str):
    """A value as front matter: texts bare, or in single quotes where bare they would be read as something else;
    line ends within them become a space."""
    text = column.cast("string")
    if kind in ("string", "date", "timestamp", "timestamp_ntz"):
        flat = F.regexp_replace(text, LINE_ENDS, " ")
        text = F.when(flat.rlike(AMBIGUOUS), F.concat(F.lit("'"), F.replace(flat, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(flat)
    return F.coalesce(text, F.lit("null"))


def _item(kind: str):
    return lambda x: F.concat(F.lit("\n  - "), _value(x, kind))


def rendered(df: DataFrame, fields: list[str], body: str) -> DataFrame:
    """relative_path and text: rows as notes, front matter first, ready for a text or Parquet writer. What is
    written reads back as it was: texts as texts, arrays as lists (null and empty ones as []), null as null."""
    head = []
    for c in fields:
        kind = df.schema[c].dataType.simpleString()
        if kind.startswith("array<"):
            items = F.transform(c, _item(kind[6:-1]))
            head.append(F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(f"{c}: []")).otherwise(F.concat(F.lit(f"{c}:"), F.array_join(items, ""))))
        else:
            head.append(F.concat(F.lit(f"{c}: "), _value(F.col(c), kind)))
    return df.select("relative_path", F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), F.coalesce(F.col(body), F.lit(""))).alias("text"))


def references(found: DataFrame) -> DataFrame:
    """note_id, source_path, target_note_id, target_path, relation, source_kind, confidence, edge_id of the
    links of each note. found: note_id, source_path, place (their order), target_note_id, target_path,
    relation, source_kind. Links to the note itself go; of links that agree in target, relation and
    kind the first counts; those of the front matter (confidence 1) stand before those of the body (0.5)."""
    nil = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = found.where(~(nil("target_path") == F.col("source_path")) & ~F.coalesce(F.col("target_note_id") == F.col("note_id"), F.lit(False)))
    same = ["note_id", "source_path", "target_path", "relation", "source_kind", "target_note_id"]
    first = rows.groupBy(*same).agg(F.min(F.struct(F.col("source_kind") != "frontmatter", "place")).alias("_p"))
    material = F.concat_ws("|", "note_id", "source_path", nil("target_note_id"), nil("target_path"), "relation", "source_kind")
    return first.select(*same, F.when(F.col("source_kind") == "frontmatter", 1.0).otherwise(0.5).alias("confidence"), F.sha2(material, 256).alias("edge_id"), "_p.place")


#: Relations of front-matter fields (fixed values); other fields link nothing.
RELATION_FIELDS = {"source_ref_links": "cites", "source_refs": "cites"} | {r: r for r in "derived_from related supersedes duplicates supports extends contradicts contains promotes_to blocks resolves".split()}


def relation_targets(field: str, raw: str | None) -> list[dict]:
    """The targets of a relation field: a path, a JSON list of them, or objects with path or target_path, id
    or target_note_id, and their own relation; source_refs also by detail_path and source_id."""
    import json

    relation = RELATION_FIELDS.get(field)
    if relation is None or raw is None or not raw.strip():
        return []
    try:
        value = json.loads(raw)
    except ValueError:
        value = raw.strip()
    out = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, str) and item.strip():
            out.append({"relation": relation, "target_path": item.strip(), "target_note_id": None})
        elif isinstance(item, dict):
            more = ("detail_path", "source_id") if field == "source_refs" else ()
            path = next((item[k] for k in ("path", "target_path", *more[:1]) if isinstance(item.get(k), str) and item[k].strip()), None)
            note = next((item[k] for k in ("id", "target_note_id", *more[1:]) if isinstance(item.get(k), str) and item[k].strip()), None)
            if path or note:
                out.append({"relation": item.get("relation") or relation, "target_path": path, "target_note_id": note})
    return out


def expanded_relations(fields: DataFrame) -> DataFrame:
    """note_id, place, relation, target_path, target_note_id for each target of the relation fields of notes
    (note_id, field, value). A note with source_ref_links has its source_refs left out."""

    @F.pandas_udf("array<struct<relation:string,target_path:string,target_note_id:string>>")
    def targets(field: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([relation_targets(f, v) for f, v in zip(field, value, strict=True)])

    linked = fields.where("field = 'source_ref_links' and trim(value) != ''").select("note_id", F.lit("source_refs").alias("field")).distinct()
    rows = fields.join(linked, ["note_id", "field"], "left_anti").where(F.col("field").isin(list(RELATION_FIELDS)))
    return rows.select("note_id", "field", F.posexplode(targets("field", "value")).alias("place", "t")).select("note_id", "field", "place", "t.relation", "t.target_path", "t.target_note_id")


#: Texts that look like a collection written out by a program are no values (fixed pattern).
LEGACY = r"^(\(.*\)|\[.*\]|\{.*\}|(set|frozenset)\(.*\))$"


def normalised_list(values):
    """A metadata list: items trimmed, empty ones and repeats left out; null where one looks like a legacy
    collection. A null list is empty."""
    items = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.when(~F.exists(items, lambda x: F.coalesce(x.rlike("(?s)" + LEGACY), F.lit(False))), F.array_distinct(F.filter(items, lambda x: F.coalesce(x != "", F.lit(False)))))


def normalised_boolean(value):
    """true or false in any case, white space around it aside; null for anything else."""
    flat = F.lower(F.trim(value))
    return F.when(flat == "true", True).when(flat == "false", False)
