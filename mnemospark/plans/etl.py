"""Queries from Markdown to rows: notes are written from the driver's tables, so SQL knows what is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import register
from mnemospark.operators import embedding, lint, records
from mnemospark.plans.registry import query
from mnemospark.session import table
from mnemospark.sources import markdown

#: Parts as notes: every eleventh has a key twice, every thirteenth doesn't close its front matter.
NOTE = """note as (select p_partkey as id, 'n/' || p_partkey || '.md' as path, p_partkey % 11 = 0 as twice, p_partkey % 13 = 0 and p_partkey % 11 > 0 as unclosed, * from part)"""


def _notes(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    """spread: dealt out by key first, as a small file is read by few tasks."""
    p = table(spark, sf, "part")
    p = p.repartition("p_partkey") if spread else p
    key, c = F.col("p_partkey"), F.concat
    lines = [
        F.lit("---"), c(F.lit("title: '"), "p_name", F.lit("''s'")), c(F.lit("tags: [ "), "p_type", F.lit(", \""), "p_brand", F.lit(", x\", ]")), F.lit("refs:"), F.lit("  - r1"), c(F.lit("  - "), "p_size"), F.lit("  more: no"),
        c(F.lit("size: "), "p_size"), c(F.lit("ratio: 0."), "p_size"), F.when(key % 11 == 0, "size: 1"), F.lit("empty:"), F.lit("done: TRUE"), F.when((key % 13 != 0) | (key % 11 == 0), "---"),
        c(F.lit("# "), "p_type"), c(F.lit("About [[c/"), "p_type", F.lit("#Top|it]] and ![["), "p_name", F.lit(".png]], `[[no]]`.")), F.lit("```"), F.lit("# code"), F.lit("```"), c(F.lit("## "), "p_brand", F.lit(" ##")), F.col("p_name"),
    ]
    return p.select(c(F.lit("n/"), "p_partkey", F.lit(".md")).alias("relative_path"), F.concat_ws("\n", *lines).alias("text"))


@query("d1_analysis", f"""with {NOTE}, b as (select *, '# ' || p_type || chr(10) || 'About [[c/' || p_type || '#Top|it]] and ![[' || p_name || '.png]], `[[no]]`.' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '## ' || p_brand || ' ##' || chr(10) || p_name as body from note)
select path, case when twice or unclosed then 'FRONTMATTER_PARSE_ERROR' end as error, case when not (twice or unclosed) then sha256(body) end as content_hash from b""")
def analysis(spark, sf):
    n = markdown.notes(_notes(spark, sf))
    return n.select(F.col("relative_path").alias("path"), "error", F.when(F.col("error").isNull(), F.col("content_hash")).alias("content_hash"))


@query("d3_front_matter", f"""with {NOTE}, e as (select path, unnest([{{'key': 'title', 'kind': 'string', 'v': p_name || '''s'}}, {{'key': 'tags', 'kind': 'list', 'v': p_type || '|' || p_brand || ', x|-'}}, {{'key': 'refs', 'kind': 'list', 'v': 'r1|' || p_size}}, {{'key': 'size', 'kind': 'integer', 'v': p_size::varchar}},
  {{'key': 'ratio', 'kind': 'float', 'v': '0.' || p_size}}, {{'key': 'empty', 'kind': 'list', 'v': ''}}, {{'key': 'done', 'kind': 'boolean', 'v': 'true'}}]) as x from note where not (twice or unclosed)) select path, x.key as key, x.kind as kind, x.v as value from e""")
def front_matter(spark, sf):
    n = markdown.notes(_notes(spark, sf)).select("relative_path", F.explode("frontmatter").alias("e"))
    value = F.array_join(F.transform("e.values", lambda x: F.coalesce(x, F.lit("-"))), "|")
    return n.select(F.col("relative_path").alias("path"), "e.key", "e.kind", value.alias("value"))


@query("d5_headings", f"with {NOTE}, h as (select path, unnest([{{'level': 1, 'text': p_type}}, {{'level': 2, 'text': p_brand}}]) as x from note where not (twice or unclosed)) select path, x.level as level, x.text as text from h")
def headings(spark, sf):
    n = markdown.notes(_notes(spark, sf)).where("error is null").select("relative_path", F.explode("headings").alias("h"))
    return n.select(F.col("relative_path").alias("path"), "h.level", "h.text")


@query("d6_chunks", f"""with {NOTE}, k as (select path, unnest([{{'i': 0, 'h': p_type, 't': '# ' || p_type || chr(10) || 'About [[c/' || p_type || '#Top|it]] and ![[' || p_name || '.png]], `[[no]]`.' || chr(10) || '```'}}, {{'i': 1, 'h': 'code', 't': '# code' || chr(10) || '```'}}, {{'i': 2, 'h': 'code>' || p_brand || ' ##', 't': '## ' || p_brand || ' ##' || chr(10) || p_name}}]) as x from note where not (twice or unclosed))
select path, x.i as chunk_index, x.h as heading_path, sha256(x.t) as content_hash from k""")
def chunks(spark, sf):
    n = markdown.notes(_notes(spark, sf)).where("error is null").select("relative_path", F.explode("chunks").alias("c"))
    return n.select(F.col("relative_path").alias("path"), F.col("c.index").alias("chunk_index"), F.array_join("c.heading_path", ">").alias("heading_path"), F.sha2("c.content", 256).alias("content_hash"))


def _last(mark: str, width: int) -> str:
    """Where a cut after the last mark in the second half of a chunk lies; null where there is none."""
    return f"case when strpos(reverse(half), reverse({mark})) > 0 then start + 350 + length(half) - (strpos(reverse(half), reverse({mark})) - 1) - length({mark}) + {width} end"


@query("d7_chunk_cuts", rf"""with recursive raw as (select doc_id, coalesce(replace(text, '#', '+'), '') as t from documents),
src as (select doc_id, length(t) - length(regexp_replace(t, '^\s+', '')) as lead, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') as t from raw where regexp_matches(t, '\S')),
cut as (select doc_id, 0::bigint as start, (select 0)::bigint as stop, false as done from src where false union all select doc_id, start, stop, done from (
  select doc_id, start, case when start + 700 >= n then n else coalesce({_last("chr(10) || chr(10)", 2)}, {_last("chr(10)", 1)}, {_last("'. '", 1)}, {_last("' '", 1)}, start + 700) end as stop, start + 700 >= n as done from (
    select doc_id, 0::bigint as start, length(t) as n, substring(t, 351, 350) as half from src))
  union all select doc_id, start, case when start + 700 >= n then n else coalesce({_last("chr(10) || chr(10)", 2)}, {_last("chr(10)", 1)}, {_last("'. '", 1)}, {_last("' '", 1)}, start + 700) end as stop, start + 700 >= n as done from (
    select doc_id, start, length(t) as n, substring(t, start + 351, 350) as half from (
      select c.doc_id, t, low + length(regexp_extract(substring(t, low::bigint, stop - low), '^\S*')) as start from (select *, greatest(start + 1, stop - 80) as low from cut where not done) c join src using (doc_id)))),
piece as (select doc_id, lead, start, substring(t, start + 1, stop - start) as x from cut join src using (doc_id)),
bare as (select doc_id, lead + start + length(x) - length(regexp_replace(x, '^\s+', '')) as start, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') as x from piece)
select doc_id, start::bigint as start, (start + length(x))::bigint as stop, sha256(x) as content_hash from bare where x <> ''""")
def chunk_cuts(spark, sf):
    """Texts without headings, so that a text is one section, which is cut by size."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.replace("text", F.lit("#"), F.lit("+")).alias("text"))
    n = markdown.notes(d, most=700, overlap=80).select("relative_path", F.explode("chunks").alias("c")).where("c.kind = 'content'")
    return n.select(F.col("relative_path").cast("long").alias("doc_id"), F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("stop"), F.sha2("c.content", 256).alias("content_hash"))


@query("d6_source_ranges", "select p_partkey, true as chunks_lie_there, true as links_lie_there, 3 as chunks, 2 as links from part where p_partkey % 11 > 0 and p_partkey % 13 > 0")
def source_ranges(spark, sf):
    """Whether ranges in the whole file, in characters and in bytes, hold the chunks and links; files with signs of
    two to four bytes and lines that end in two signs."""
    f = _notes(spark, sf, spread=True).withColumn("text", F.replace(F.concat("text", F.lit("\nend 𝄞 [[é ß]]")), F.lit("About"), F.lit("Über 你好\r\n")))
    f = f.withColumn("text", F.regexp_replace("text", r"`\[\[no\]\]`\.", "."))
    n = markdown.notes(f, keep=("text",)).where("error is null")
    raw = F.encode("text", "UTF-8")
    lies = lambda x, content: (F.substring("text", x["start"] + 1, x["end"] - x["start"]) == content) & (F.decode(F.substring(raw, x["byte_start"] + 1, x["byte_end"] - x["byte_start"]), "UTF-8") == content)
    return n.select(
        F.regexp_extract("relative_path", "[0-9]+", 0).cast("long").alias("p_partkey"), F.forall("chunks", lambda c: lies(c, c["content"])).alias("chunks_lie_there"), F.forall("links", lambda x: lies(x, x["raw"])).alias("links_lie_there"),
        F.size("chunks").alias("chunks"), (F.size("links") - 1).alias("links"),
    )


@query("d9_links", f"with {NOTE}, l as (select path, unnest([{{'kind': 'wikilink', 'target': 'c/' || p_type, 'heading': 'Top', 'alias': 'it'}}, {{'kind': 'embed', 'target': p_name || '.png', 'heading': '', 'alias': ''}}]) as x from note where not (twice or unclosed)) select path, x.kind as kind, x.target as target, x.heading as heading, x.alias as alias from l")
def links(spark, sf):
    n = markdown.notes(_notes(spark, sf)).where("error is null").select("relative_path", F.explode("links").alias("l"))
    nil = lambda c: F.coalesce(c, F.lit("")).alias(c.split(".")[1])
    return n.select(F.col("relative_path").alias("path"), "l.kind", "l.target", nil("l.heading"), nil("l.alias"))


@query("d11_edges", """with r as (select 'c' || o_custkey as note_id, 'n/c' || o_custkey || '.md' as source_path, case when l_linenumber = 1 then 's' || l_suppkey end as target_note_id, case when l_suppkey % 7 = 0 then 'n/c' || o_custkey || '.md' else 'n/s' || l_suppkey || '.md' end as target_path,
  case when l_returnflag = 'A' then 'cites' else 'wikilink' end as relation, case when l_returnflag = 'A' then 'frontmatter' else 'wikilink' end as source_kind from lineitem join orders on o_orderkey = l_orderkey)
select distinct note_id, target_path, relation, case source_kind when 'frontmatter' then 1.0 else 0.5 end::double as confidence, sha256(note_id || '|' || source_path || '|' || coalesce(target_note_id, '') || '|' || target_path || '|' || relation || '|' || source_kind) as edge_id from r where source_path <> target_path""")
def edge_candidates(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    own, front = F.concat(F.lit("n/c"), "o_custkey", F.lit(".md")), F.col("l_returnflag") == "A"
    found = j.select(
        F.concat(F.lit("c"), "o_custkey").alias("note_id"), own.alias("source_path"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("s"), "l_suppkey")).alias("target_note_id"),
        F.when(F.col("l_suppkey") % 7 == 0, own).otherwise(F.concat(F.lit("n/s"), "l_suppkey", F.lit(".md"))).alias("target_path"),
        F.when(front, "cites").otherwise("wikilink").alias("relation"), F.when(front, "frontmatter").otherwise("wikilink").alias("source_kind"), F.col("l_linenumber").alias("place"),
    )
    return markdown.references(found).select("note_id", "target_path", "relation", "confidence", "edge_id")


@query("d13_finalised_batch", "select coalesce(a.vec_id, b.vec_id) as vec_id, case when a.vec_id is null then 'UNKNOWN_ITEM' when b.vec_id is null then 'MISSING_VECTOR' when b.vec_id % 7 = 0 then 'DIMENSION_MISMATCH' when b.vec_id % 11 = 0 then 'NON_FINITE_VECTOR' end as error from (select vec_id from embeddings where label > 0) a full join (select vec_id from embeddings where label < 9) b on a.vec_id = b.vec_id")
def finalised_batch(spark, sf):
    e = table(spark, sf, "embeddings")
    key, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    out = F.when(key % 7 == 0, F.slice(v, 1, 63)).when(key % 11 == 0, F.transform(v, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x))).otherwise(v)
    return embedding.finalised(e.where("label > 0"), e.where("label < 9").select("vec_id", out.alias("embedding")), "vec_id", 64).select("vec_id", "error")


@query("d14_byte_embedding", """with b as (select c_custkey, list_transform(range(8), lambda k: list_sum(list_transform(list_filter(range(length(c_name)), lambda i: i % 8 = k), lambda i: ord(c_name[i + 1]) / 255))) as v from customer)
select c_custkey, round(v[1] / n, 6)::double as first, round(v[8] / n, 6)::double as last from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from b)""")
def byte_embedding(spark, sf):
    e = table(spark, sf, "customer").select("c_custkey", embedding.byte_embedding(F.col("c_name")).alias("v"))
    return e.select("c_custkey", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[7], 6).alias("last"))


@query("d14_inferred", """with b as (select p_partkey, p_name, list_transform(range(8), lambda k: list_sum(list_transform(list_filter(range(length(p_name)), lambda i: i % 8 = k), lambda i: ord(p_name[i + 1]) / 255))) as v from part)
select p_partkey, case when p_name like '%red%' then -1 else round(v[1] / n, 6)::double end as first, case when p_name like '%red%' then 'INFERENCE_FAILED' else '-' end as error from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from b)""")
def inferred(spark, sf):
    """Parts in batches of 16; those that the model refuses are set aside one by one."""
    e = embedding.inferred(table(spark, sf, "part"), "p_partkey", "p_name", embedding.ByteProvider(refused="red"), 16)
    return e.select("p_partkey", F.coalesce(F.round(F.col("embedding")[0], 6), F.lit(-1.0)).alias("first"), F.coalesce("error", F.lit("-")).alias("error"))


@query("u1_provider_in_sql", """with b as (select c_custkey, list_transform(range(8), lambda k: list_sum(list_transform(list_filter(range(length(c_name)), lambda i: i % 8 = k), lambda i: ord(c_name[i + 1]) / 255))) as v from customer)
select c_custkey, round(v[2] / n, 6)::double as second from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from b)""")
def provider_in_sql(spark, sf):
    embedding.register_provider(spark, "mnemo_embed_bytes", embedding.ByteProvider())
    table(spark, sf, "customer").createOrReplaceTempView("mnemospark_customer")
    return spark.sql("select c_custkey, round(mnemo_embed_bytes(c_name)[1], 6) as second from mnemospark_customer")


@query("r31_shared_budget", """with r as (select 0 as n, 'customer' as source, c_custkey as k, c_name as text, c_custkey % 3 > 0 as stale, case when c_custkey % 4 > 0 then c_nationkey end as since from customer
 union all select 1, 'part', p_partkey, p_name, p_partkey % 5 > 0, case when p_partkey % 2 > 0 then p_size end from part),
top as (select * from r order by stale desc, n, since nulls first, k limit (select (select count(*) from customer) + (select count(*) from part) * 4 // 5)), b as (select *, list_transform(range(8), lambda k: list_sum(list_transform(list_filter(range(length(text)), lambda i: i % 8 = k), lambda i: ord(text[i + 1]) / 255))) as v from top)
select source, k as key, round(v[1] / len, 6)::double as first from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as len from b)""")
def shared_budget(spark, sf):
    """A forced reindex over two sources, with vectors: the budget covers all stale rows and some that are current."""
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    k = F.col("c_custkey")
    one = c.select(k.alias("key"), F.col("c_name").alias("text"), (k % 3 > 0).alias("stale"), F.when(k % 4 > 0, F.col("c_nationkey")).alias("embedded_at"), k.alias("created_at"))
    k = F.col("p_partkey")
    two = p.select(k.alias("key"), F.col("p_name").alias("text"), (k % 5 > 0).alias("stale"), F.when(k % 2 > 0, F.col("p_size")).alias("embedded_at"), k.alias("created_at"))
    picked = embedding.reindex_selection_of([("customer", one), ("part", two)], c.count() + p.count() * 4 // 5, force=True)
    named = picked.withColumn("id", F.concat_ws(":", "source", "key"))
    e = embedding.inferred(named, "id", "text", embedding.ByteProvider())
    return e.select(F.split_part("id", F.lit(":"), F.lit(1)).alias("source"), F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("key"), F.round(F.col("embedding")[0], 6).alias("first"))


@query("d16_relation_fields", """select s_suppkey as note_id, f.field, f.place, f.relation, f.target from (select s_suppkey, unnest(case s_suppkey % 3 when 0 then [{'field': 'related', 'place': 0, 'relation': 'related', 'target': 'n/' || s_suppkey || '.md'}] when 1 then [{'field': 'supersedes', 'place': 0, 'relation': 'supersedes', 'target': 'a.md'}, {'field': 'supersedes', 'place': 1, 'relation': 'extends', 'target': 'id' || s_suppkey}]
  else [{'field': 'source_ref_links', 'place': 0, 'relation': 'cites', 'target': 'x.md'}, {'field': 'blocks', 'place': 0, 'relation': 'blocks', 'target': 'y.md'}] end) as f from supplier)""")
def relation_fields(spark, sf):
    k = F.col("s_suppkey")
    field = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    f = (
        F.when(k % 3 == 0, F.array(field("related", F.concat(F.lit("n/"), k, F.lit(".md"))), field("title", F.lit("no link"))))
        .when(k % 3 == 1, F.array(field("supersedes", F.concat(F.lit('["a.md", {"id": "id'), k, F.lit('", "relation": "extends"}, 5]')))))
        .otherwise(F.array(field("source_ref_links", F.lit("x.md")), field("source_refs", F.lit("z.md")), field("blocks", F.lit('{"target_path": "y.md"}'))))
    )
    rows = table(spark, sf, "supplier").select(k.alias("note_id"), F.explode(f).alias("f")).select("note_id", "f.field", "f.value")
    return markdown.expanded_relations(rows).select("note_id", "field", "place", "relation", F.coalesce("target_path", "target_note_id").alias("target"))


@query("d17_context_mapping", """select 'note:' || doc_id as context_id, case when lang = 'en' then 'PROJECT' else case when source is not null then 'PROJECT' else 'GLOBAL' end end as scope, coalesce(case when doc_id % 3 = 0 then upper(lang) end, 'NOTE') as kind, coalesce(case when doc_id % 4 > 0 then doc_id end, n_chars) as created_at from documents""")
def context_mapping(spark, sf):
    d, key = table(spark, sf, "documents"), F.col("doc_id")
    notes = d.select(key.cast("string").alias("note_id"), F.when(F.col("lang") == "en", "project").alias("scope"), F.col("source").alias("project"), F.when(key % 3 == 0, F.col("lang")).alias("kind"), F.lit("note").alias("note_type"), F.when(key % 4 > 0, key).alias("created_at"), F.col("n_chars").alias("indexed_at"))
    return records.context_of(notes)


@query("d18_context_validation", """select event_id, case when event_type = 'signup' then 'SCOPE_REQUIRED' when event_type = 'error' then 'SCOPE_INVALID' when value > 50 then 'STATUS_INVALID' when user_id % 10 = 0 then 'PROJECT_REQUIRED' when event_id % 17 = 0 then 'TIMESTAMP_INVALID' end as error from events""")
def context_validation(spark, sf):
    kind = F.col("event_type")
    c = table(spark, sf, "events").select(
        "event_id", F.when(kind == "error", "Everywhere").when(kind != "signup", " project ").alias("scope"), F.when(F.col("value") > 50, "lost").otherwise("Active").alias("status"),
        F.when(F.col("user_id") % 10 != 0, "p").alias("project"), F.when(F.col("event_id") % 17 == 0, "yesterday").otherwise("2026-01-02T03:04:05Z").alias("created_at"),
    )
    return c.select("event_id", records.context_error(F.col("scope"), F.col("status"), F.col("project"), F.col("created_at")).alias("error"))


@query("d19_metadata_lists", """select p_partkey, case when p_size % 10 > 0 then string_agg(distinct x, ',' order by x) end as tags, case p_size % 3 when 0 then 'true' when 1 then 'false' else '-' end as flag from (select p_partkey, p_size, unnest([p_name, p_type, p_brand]) as x from part) group by 1, p_size""")
def metadata_lists(spark, sf):
    raw = F.array(F.concat(F.lit(" "), "p_name"), F.col("p_name"), F.col("p_type"), F.lit("  "), F.col("p_brand"), F.when(F.col("p_size") % 10 == 0, F.lit("('a', 'b')")))
    flag = F.when(F.col("p_size") % 3 == 0, " True").when(F.col("p_size") % 3 == 1, "FALSE").otherwise("yes")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(markdown.normalised_list(raw)), ",").alias("tags"), F.coalesce(markdown.normalised_boolean(flag).cast("string"), F.lit("-")).alias("flag"))


# -- quality of metadata ---------------------------------------------------------------------------------


@query("q7_metadata_redaction", """select s_suppkey, case when s_suppkey % 2 = 0 then '{"a":"[REDACTED]","deep":[{"n":' || s_suppkey || '}],"secret_values_recorded":false}' else '{"title":"' || s_name || '"}' end as redacted from supplier""")
def metadata_redaction(spark, sf):
    k = F.col("s_suppkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit('{"a": "password=hunter22", "api_key": "x", "deep": [{"token": 1, "n": '), k, F.lit('}], "secret_values_recorded": false}'))).otherwise(F.concat(F.lit('{"title": "'), "s_name", F.lit('"}')))
    return table(spark, sf, "supplier").select("s_suppkey", lint.redacted_json(raw).alias("redacted"))


INTEGRITY = """f as (select p_partkey as note_id, unnest([{'field': 'tags', 'code': case p_size % 5 when 0 then 'LEGACY_COLLECTION' when 1 then 'WRONG_COLLECTION_TYPE' end}, {'field': 'title', 'code': case when p_size % 7 = 0 then 'EMPTY_SCALAR' end}, {'field': 'done', 'code': case p_size % 4 when 0 then 'WRONG_BOOLEAN_TYPE' end}, {'field': 'url', 'code': case when p_size % 9 = 0 then 'UNRECOVERABLE_URL' end}]) as x from part),
found as (select note_id, x.field as field, x.code as code from f where x.code is not null)"""


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    entry = lambda field, kind, value: F.struct(F.lit(field).alias("field"), kind.alias("kind"), value.alias("value"))
    tags = entry("tags", F.when(size % 5 <= 1, F.when(size % 5 == 0, "string").otherwise("integer")).otherwise("list"), F.when(size % 5 == 0, "('a', 'b')").when(size % 5 == 1, "12").otherwise("a"))
    title = entry("title", F.lit("string"), F.when(size % 7 == 0, " ").otherwise(F.col("p_name")))
    done = entry("done", F.when(size % 4 == 0, "string").otherwise("boolean"), F.when(size % 4 == 0, "maybe").otherwise("true"))
    url = entry("url", F.lit("string"), F.when(size % 9 == 0, "http//broken").otherwise("https://a.example/x"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("note_id"), F.explode(F.array(tags, title, done, url)).alias("e")).select("note_id", "e.*")


@query("q8_integrity_scan", f"with {INTEGRITY} select code, count(*) as findings, count(distinct note_id) as notes, count(distinct field) as fields from found group by 1")
def integrity_scan(spark, sf):
    return records.findings(lint.integrity(_metadata(spark, sf)), "code", "note_id", "field")


@query("q15_repair_plan", f"with {INTEGRITY}, r as (select note_id, field, case code when 'LEGACY_COLLECTION' then '[\"a\",\"b\"]' when 'WRONG_COLLECTION_TYPE' then '[\"12\"]' end as replacement from found) select note_id, count(*) as repairs, sha256(string_agg(field || '=' || replacement, chr(10) order by field)) as plan_hash from r where replacement is not null group by 1")
def repair_plan(spark, sf):
    return lint.repair_plan(lint.integrity(_metadata(spark, sf)))


@query("u1_functions", "select p_partkey, len(regexp_extract_all(p_name, '[a-z]+'))::int as tokens, length(p_name) as n from part")
def registered_functions(spark, sf):
    register(spark)
    table(spark, sf, "part").createOrReplaceTempView("mnemospark_part")
    return spark.sql("select p_partkey, mnemo_token_count(p_name) as tokens, cast(length(mnemo_folded(p_name)) as bigint) as n from mnemospark_part")


@query("u3_table_function", "select p_partkey, unnest(range(len(string_split(p_name, ' '))))::int as place, unnest(string_split(p_name, ' ')) as token from part")
def table_function(spark, sf):
    register(spark)
    table(spark, sf, "part").createOrReplaceTempView("mnemospark_part")
    return spark.sql("select p_partkey, t.place, t.token from mnemospark_part, lateral mnemo_tokens(p_name) t")
