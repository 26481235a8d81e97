"""Queries of stored notes and of front matter as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import front_json
from mnemospark.plans.registry import query
from mnemospark.session import shared_folder, table
from mnemospark.sources import markdown, vault
from mnemospark.sources.note_store import NoteStore, write_files

_c = F.concat


def _notes(spark: SparkSession, sf: str, edit: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as notes: two chunks (the name, then the segment) and an edge to the nation."""
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, _c("c_name", F.lit(edit))).otherwise(F.col("c_name"))
    c = c.withColumn("name", name).withColumn("note_id", _c(F.lit("c"), "c_custkey"))
    chunk = lambda i, t: F.struct(F.lit(i).alias("chunk_index"), F.sha2(t, 256).alias("content_hash"))
    chunks = c.select("note_id", F.explode(F.array(chunk(0, F.col("name")), chunk(1, F.col("c_mktsegment")))).alias("x")).select("note_id", "x.*")
    return c.select("note_id", F.sha2(_c("name", "c_mktsegment"), 256).alias("content_hash")), chunks, c.select("note_id", _c("note_id", F.lit(">n"), "c_nationkey").alias("edge_id"))


@query("s8_note_store", """with n as (select 'c' || c_custkey as note_id, c_custkey as k, case when c_custkey % 5 = 0 then c_name || '!' else c_name end as name, c_mktsegment as seg, c_nationkey as nation from customer where c_custkey % 7 > 0)
select note_id, 0 as chunk_index, sha256(name) as content_hash, k % 5 > 0 as embedded, sha256(name || seg) as note_hash, note_id || '>n' || nation as edge_id from n union all select note_id, 1, sha256(seg), true, sha256(name || seg), note_id || '>n' || nation from n""")
def note_store(spark, sf):
    """Written with embeddings, then again with every fifth note changed, no embeddings, and every seventh removed."""
    store = NoteStore(spark, f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}", buckets=16)
    notes, chunks, edges = _notes(spark, sf, "")
    store.write(notes, chunks.withColumn("embedding", F.array(F.length("note_id").cast("double"))), edges)
    notes, chunks, edges = _notes(spark, sf, "!")
    gone = table(spark, sf, "customer").where("c_custkey % 7 = 0").select(_c(F.lit("c"), "c_custkey").alias("note_id"))
    store.write(notes, chunks.withColumn("embedding", F.lit(None).cast("array<double>")), edges, gone)
    left = store.table("chunks").select("note_id", "chunk_index", "content_hash", F.col("embedding").isNotNull().alias("embedded"))
    return left.join(store.table("notes").select("note_id", F.col("content_hash").alias("note_hash")), "note_id", "full_outer").join(store.table("edges"), "note_id", "full_outer")


@query("s10_files", "select p_partkey, sha256(p_name) as digest, strlen(p_name)::bigint as size, case when p_partkey % 9 = 0 then 'UNSAFE_PATH' else '-' end as error, case when p_partkey % 9 > 0 then p_name else '-' end as found from part")
def files(spark, sf):
    """Parts as files, read again."""
    p, root = table(spark, sf, "part"), f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    path = F.when(F.col("p_partkey") % 9 == 0, _c(F.lit("a/../../"), "p_partkey")).otherwise(_c(F.lit("d"), F.col("p_partkey") % 3, F.lit("/"), "p_partkey", F.lit(".md")))
    receipt = write_files(p.select(path.alias("relative_path"), F.col("p_name").alias("text")), root).checkpoint()
    seen = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root).select(F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("long").alias("p_partkey"), F.decode("content", "UTF-8").alias("found"))
    receipt = receipt.select(F.regexp_extract("relative_path", r"([0-9]+)(\.md)?$", 1).cast("long").alias("p_partkey"), F.col("sha256").alias("digest"), "size", F.coalesce("error", F.lit("-")).alias("error"))
    return receipt.join(seen, "p_partkey", "left").fillna("-", ["found"])


def _vault(spark: SparkSession, sf: str) -> tuple[str, int]:
    """Parts as notes in three folders, and their number; every seventh has front matter that is never closed. Parts are
    dealt out by key first, as a small file is read by few tasks."""
    p, root = table(spark, sf, "part").repartition("p_partkey"), f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"
    path = _c(F.lit("d"), F.col("p_partkey") % 3, F.lit("/"), "p_partkey", F.lit(".md"))
    text = F.when(F.col("p_partkey") % 7 == 0, _c(F.lit("---\ntitle: "), "p_name")).otherwise(_c(F.lit("---\ntitle: "), "p_name", F.lit("\n---\n# "), "p_brand"))
    write_files(p.select(path.alias("relative_path"), text.alias("text")), root).write.parquet(f"{root}-receipt")
    return root, p.count()


@query("s2_bounded_scan", """with p as (select p_partkey, case when p_partkey % 7 = 0 then '---' || chr(10) || 'title: ' || p_name else '---' || chr(10) || 'title: ' || p_name || chr(10) || '---' || chr(10) || '# ' || p_brand end as text, row_number() over (order by p_partkey % 3 desc, p_partkey || '.md') as n, count(*) over () as files from part)
select p_partkey, sha256(text) as digest, '-' as error, false as complete from p where n <= files // 2 union all select -1, '-', 'SOURCE_SCAN_LIMIT_EXCEEDED', false from (select count(*) as n from part) where n > 0""")
def bounded_scan(spark, sf):
    """A vault of parts, scanned with a ceiling of half its files (at least one): folders come last name first."""
    root, files = _vault(spark, sf)
    key = F.coalesce(F.regexp_extract("relative_path", r"([0-9]+)\.md$", 1).cast("long"), F.lit(-1).cast("long"))
    found = vault.bounded_scan(spark, root, max_files=max(files // 2, 1))
    return found.select(key.alias("p_partkey"), F.coalesce(F.sha2("text", 256), F.lit("-")).alias("digest"), F.coalesce("error", F.lit("-")).alias("error"), "complete")


@query("s4_source_snapshot", """select p_partkey, case when p_partkey % 7 = 0 then 'FRONTMATTER_PARSE_ERROR' else '-' end as error, case when p_partkey % 7 = 0 then '-' else p_name end as title, case when p_partkey % 7 = 0 then '-' else p_brand end as heading from part where p_partkey % 3 = 1""")
def source_snapshot(spark, sf):
    """Notes of one folder with what is read from them, or the code of what went wrong. The ceilings are all that
    was written: the files, their bytes, and three folders beside them."""
    root, files = _vault(spark, sf)
    size = spark.read.parquet(f"{root}-receipt").agg(F.sum("size")).first()[0] or 0
    found = vault.bounded_scan(spark, root, max_entries=files + 3, max_files=max(files, 1), max_total_bytes=max(size, 1)).where(F.col("relative_path").startswith("d1/"))
    notes = markdown.notes(found)
    read = lambda c: F.when(F.col("error").isNull(), c).otherwise("-")
    return notes.select(F.regexp_extract("relative_path", r"([0-9]+)\.md$", 1).cast("long").alias("p_partkey"), F.coalesce("error", F.lit("-")).alias("error"), read(F.col("title")).alias("title"), read(F.get("headings", F.lit(0))["text"]).alias("heading"))


# -- front matter as JSON ------------------------------------------------------------------------------


def _fronts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with front matter of many kinds, by their key."""
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 12
    q = lambda *parts: _c(*[F.lit(x) if x[:2] != "p_" else F.col(x) for x in parts])
    front = (
        F.when(k == 0, q('{"scope": " project ", "project": "', "p_brand", '", "aliases": "', "p_name", '", "x": 1}')).when(k == 1, q('{"scope": "user", "aliases": ["a", " ', "p_name", ' ", ""], "status": "Saved", "note": {"a": [1]}}'))
        .when(k == 2, "{broken").when(k == 3, "[1]").when(k == 4, '{"aliases": ["red"]}').when(k == 5, '{"scope": "WORLD"}').when(k == 6, '{"scope": "GLOBAL", "status": "odd"}').when(k == 7, '{"scope": "PROJECT"}')
        .when(k == 8, '{"scope": "GLOBAL", "evidence_refs": {"a": 1}}').when(k == 9, '{"scope": "GLOBAL", "valid_from": "2024-13-45"}')
        .when(k == 10, '{"scope": "AGENT", "agent_id": "a1", "kind": "fact", "created_at": "2024-02-03", "evidence_refs": ["e1", "e1", " e2 "], "provenance": {"source_run_id": "r9", "confidence": "high", "evidence_refs": ["e1", "e2"]}}')
        .otherwise('{"scope": "GLOBAL", "source_run_id": "r1", "provenance": {"source_run_id": "r2"}}')
    )
    return p.select("p_partkey", front.alias("front"), "p_name", "p_brand", "p_type")


@query("f4_json_scope", "select p_partkey, case p_partkey % 12 when 0 then 'PROJECT' when 1 then 'USER' when 5 then 'WORLD' when 7 then 'PROJECT' when 10 then 'AGENT' when 6 then 'GLOBAL' when 8 then 'GLOBAL' when 9 then 'GLOBAL' when 11 then 'GLOBAL' else case when p_type = 'SMALL' then '-' when p_brand <> 'Brand#11' then 'PROJECT' else 'GLOBAL' end end as scope from part")
def json_scope(spark, sf):
    kind, project = F.when(F.col("p_type") == "SMALL", "context").otherwise("note"), F.when(F.col("p_brand") != "Brand#11", F.col("p_brand"))
    return _fronts(spark, sf).select("p_partkey", F.coalesce(front_json.scope_of(F.col("front"), kind, project), F.lit("-")).alias("scope"))


@query("f8_json_alias", "select p_partkey from part where p_partkey % 12 in (0, 1) and p_name = 'red ring'")
def json_alias(spark, sf):
    return _fronts(spark, sf).where(front_json.has_alias(F.col("front"), " Red  RING")).select("p_partkey")


@query("d18_json_errors", "select p_partkey, ['-', '-', 'JSON_MALFORMED', 'JSON_NOT_AN_OBJECT', 'SCOPE_REQUIRED', 'SCOPE_INVALID', 'STATUS_INVALID', 'PROJECT_REQUIRED', 'LIST_INVALID:evidence_refs', 'TIMESTAMP_INVALID:valid_from', '-', 'PROVENANCE_CONFLICT:source_run_id'][p_partkey % 12 + 1] as error from part")
def json_errors(spark, sf):
    return _fronts(spark, sf).select("p_partkey", F.coalesce(front_json.error(F.col("front")), F.lit("-")).alias("error"))


@query("d17_json_context", """select p_partkey, case p_partkey % 12 when 0 then 'PROJECT' when 1 then 'USER' else 'AGENT' end as scope, case p_partkey % 12 when 1 then 'saved' else 'active' end as status, case p_partkey % 12 when 10 then 'FACT' else upper(p_type) end as kind,
 case p_partkey % 12 when 0 then p_brand else '-' end as project, case p_partkey % 12 when 10 then 'e1,e2' else '' end as evidence, case p_partkey % 12 when 10 then 'r9 HIGH' else '- -' end as run, case p_partkey % 12 when 10 then '2024-02-03' else '1999-01-01' end as created,
 case p_partkey % 12 when 0 then 'aliases,x' when 1 then 'aliases,note' else '' end as others from part where p_partkey % 12 in (0, 1, 10)""")
def json_context(spark, sf):
    f = _fronts(spark, sf)
    c = f.select("p_partkey", front_json.error(F.col("front")).alias("e"), front_json.context(F.col("front"), F.col("p_partkey"), F.col("p_type"), F.lit("1999-01-01").cast("timestamp")).alias("c")).where("e is null")
    nil = lambda x: F.coalesce(F.col(x), F.lit("-"))
    return c.select("p_partkey", "c.scope", "c.status", "c.kind", nil("c.project").alias("project"), F.array_join("c.evidence_refs", ",").alias("evidence"), F.concat_ws(" ", nil("c.source_run_id"), nil("c.confidence")).alias("run"),
                    F.date_format("c.created_at", "yyyy-MM-dd").alias("created"), F.array_join(F.array_sort(F.map_keys("c.metadata")), ",").alias("others"))
