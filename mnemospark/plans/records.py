"""Queries over notes, contexts and logs as tables, and the writes to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import filters, records
from mnemospark.operators.rows import best_per_key
from mnemospark.plans.registry import query
from mnemospark.session import table

# -- predicates --------------------------------------------------------------------------------------


@query("f4_effective_scope", "select doc_id, case when doc_id % 3 = 0 then upper(lang) when doc_id % 3 = 1 then case when n_chars % 2 = 0 then 'PROJECT' else 'GLOBAL' end end as scope from documents")
def effective_scope(spark, sf):
    key = F.col("doc_id")
    stated = F.when(key % 3 == 0, F.concat(F.lit(" "), "lang")).when(key % 3 == 1, " ")
    return table(spark, sf, "documents").select("doc_id", records.effective_scope(stated, F.when(key % 3 == 2, "context").otherwise("note"), F.when(F.col("n_chars") % 2 == 0, F.col("source"))).alias("scope"))


@query("f7_prefix_exclusion", "select p_partkey from part where not starts_with(replace(p_name, ' ', '_'), 'red_')")
def prefix_exclusion(spark, sf):
    return table(spark, sf, "part").where(records.outside(F.translate("p_name", " ", "_"), "red_")).select("p_partkey")


@query("f8_alias_match", "select p_partkey from part where p_name = 'red ring' or p_type = 'red ring' or lower(p_brand) = 'red ring'")
def alias_match(spark, sf):
    aliases = F.array(F.concat(F.lit("  "), F.upper("p_name")), "p_type", "p_brand")
    return table(spark, sf, "part").where(records.has_alias(aliases, "RED   ring ")).select("p_partkey")


@query("f9_scope_recheck", "select doc_id from documents where ((doc_id % 2 = 0 and source = 'src1') or doc_id % 2 = 1) and lang is null or (((doc_id % 2 = 0 and source = 'src1') or doc_id % 2 = 1) and lang = 'none')")
def scope_recheck(spark, sf):
    d = table(spark, sf, "documents")
    scope = F.when(F.col("doc_id") % 2 == 0, "PROJECT").otherwise("GLOBAL")
    asked = {"PROJECT": (F.col("source"), "src1"), "GLOBAL": (F.col("source"), "")}
    return d.where(records.strictly_in_scope(scope, asked, F.col("lang"), None) | records.strictly_in_scope(scope, asked, F.col("lang"), "none")).select("doc_id")


@query("f11_inventory", "select c_custkey as note_id, c_name as title, c_mktsegment as kind, n_name as project from customer join nation on n_nationkey = c_nationkey where c_acctbal >= 0")
def inventory(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("project"))
    return table(spark, sf, "customer").where("c_acctbal >= 0").join(names, "c_nationkey").select(F.col("c_custkey").alias("note_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"), "project")


@query("f13_duplicate_probe", "select a.doc_id as id, coalesce(min(b.doc_id), -1) as duplicate_of from documents a left join documents b on a.text = b.text and a.lang is not distinct from b.lang and a.source is not distinct from b.source and a.doc_id <> b.doc_id group by 1")
def duplicate_probe(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("note").alias("kind"), F.lit("PROJECT").alias("scope"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("project"), F.col("lang").alias("user_id"))
    return records.duplicate_probe(c, c).fillna(-1, ["duplicate_of"])


@query("f14_stale_embeddings", "select vec_id from embeddings where label is distinct from 3 or len(embedding) <> 64 or vec_id % 10 = 0")
def stale_embeddings(spark, sf):
    model = F.when(F.col("vec_id") % 10 != 0, "small")
    return table(spark, sf, "embeddings").where(records.stale_embedding(model, F.size("embedding"), F.col("label").cast("string"), current=("small", 64, "3"))).select("vec_id")


# -- joins -------------------------------------------------------------------------------------------


@query("j3_candidate_semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def candidate_semi_join(spark, sf):
    found = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(found, "c_custkey", "left_semi").select("c_custkey")


@query("j4_exists_in_list", "select doc_id from documents where list_contains(list_transform(string_split(text, chr(10)), lambda x: length(x) > 400), true)")
def exists_in_list(spark, sf):
    return table(spark, sf, "documents").where(F.exists(F.split("text", "\n"), lambda x: F.length(x) > 400)).select("doc_id")


@query("j5_hydration", "with r as (select o_custkey as k, row_number() over (order by max(o_totalprice) desc, o_custkey) as rank from orders group by 1 qualify rank <= 100) select c_custkey, c_name, rank from customer join r on k = c_custkey where c_nationkey < 20")
def hydration(spark, sf):
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top")).orderBy(F.desc("top"), "c_custkey").limit(100)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("top"), "c_custkey")).cast("long"))
    return records.hydrated(ranked, table(spark, sf, "customer").where("c_nationkey < 20"), "c_custkey").select("c_custkey", "c_name", "rank")


@query("j13_overlay_lookup", "select o_orderkey, max(l_shipdate) as valid_to, max(l_returnflag) as state from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag <> 'N' group by 1")
def overlay_lookup(spark, sf):
    overlay = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("valid_to"), F.max("l_returnflag").alias("state"))
    return table(spark, sf, "orders").select("o_orderkey").join(overlay, "o_orderkey", "left")


# -- aggregates and pages ------------------------------------------------------------------------------


@query("a3_page_with_total", "select o_orderkey, (select count(*) from orders where o_orderstatus = 'F') as total from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 20 offset 40")
def page_with_total(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return records.page_with_total(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20).select("o_orderkey", "total")


@query("a5_health", "select count(*) as total, count(*) filter (event_type = 'view') as n_view, count(*) filter (event_type = 'click') as n_click, count(*) filter (event_type = 'signup') as n_signup, max(event_id) filter (event_type = 'error') as last_failure_at, arg_max(props, event_id) filter (event_type = 'error') as last_error from events")
def health(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "error", "FAILED").otherwise(F.upper("event_type")))
    return records.health(e, "status", "event_id", "props", ["VIEW", "CLICK", "SIGNUP"])


@query("a8_best_chunk", "select l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) = 1")
def best_chunk(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return best_per_key(li, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_linenumber")


@query("a9_ambiguous_names", "select p_name as name, count(distinct p_partkey) as members from part group by 1 having count(distinct p_partkey) > 1")
def ambiguous_names(spark, sf):
    return records.repeated_keys(table(spark, sf, "part").withColumnRenamed("p_name", "name"), "name", "p_partkey")


@query("a10_issue_counts", "select event_type as code, count(*) as n from events where value > 50 group by 1")
def issue_counts(spark, sf):
    return records.issue_counts(table(spark, sf, "events").where("value > 50").withColumnRenamed("event_type", "code"))


@query("a12_findings", "select l_returnflag as code, count(*) as findings, count(distinct l_orderkey) as notes, count(distinct l_linenumber) as fields from lineitem group by 1")
def findings(spark, sf):
    return records.findings(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "code"), "code", "l_orderkey", "l_linenumber")


@query("a13_failure_balance", "select scanned, valid, invalid, string_agg(code || '=' || n, ',' order by code) as failures, valid + invalid = scanned as balanced from (select event_type as code, count(*) as n from events where value > 60 group by 1), (select count(*) as scanned, count(*) filter (value <= 60) as valid, count(*) filter (value > 60) as invalid from events) group by all")
def failure_balance(spark, sf):
    out = records.failure_balance(table(spark, sf, "events"), F.when(F.col("value") > 60, F.col("event_type")))
    text = F.array_join(F.transform(F.map_entries("failures"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return out.withColumn("failures", text)


@query("a16_lane_union", "select o_custkey as k from orders where o_totalprice > 300000 union select c_custkey from customer where c_acctbal < 0 union select s_suppkey from supplier")
def lane_union(spark, sf):
    lanes = [table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))]
    return records.union_of(lanes, "k")


@query("a20_offset_page", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 15 offset 30")
def offset_page(spark, sf):
    return records.page(table(spark, sf, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 30, 15)


REINDEX = "select vec_id, row_number() over (order by case when vec_id % 7 = 0 then 0 else 1 end, case when vec_id % 3 > 0 then label end nulls first, vec_id) as place from embeddings"


@query("a21_reindex_order", f"select * from ({REINDEX}) where place <= 50")
def reindex_order(spark, sf):
    stale = F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1)
    order = [stale.asc(), F.when(F.col("vec_id") % 3 > 0, F.col("label")).asc_nulls_first(), F.asc("vec_id")]
    top = table(spark, sf, "embeddings").select("vec_id", "label").orderBy(*order).limit(50)
    return top.select("vec_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


RESULTS = "hit as (select event_id, case when event_id % 3 > 0 then ts end as seen, event_type as role, row_number() over (order by value desc, event_id) as rank from events qualify rank <= 60)"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").orderBy(F.desc("value"), "event_id").limit(60)
    return e.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("at"), F.col("event_type").alias("role"), F.row_number().over(Window.orderBy(F.desc("value"), "event_id")).alias("rank"))


@query("a22_time_preference", f"with {RESULTS} select event_id, row_number() over (order by seen desc nulls last, rank) as new_rank from hit")
def time_preference(spark, sf):
    return records.by_time_preference(_results(spark, sf), "at", "rank").select("event_id", F.col("new_rank").cast("long").alias("new_rank"))


@query("a23_role_preference", f"with {RESULTS} select event_id, row_number() over (order by case role when 'error' then 1 when 'view' then 2 else 3 end, rank) as new_rank from hit")
def role_preference(spark, sf):
    return records.by_role_preference(_results(spark, sf), "role", ["error", "view"], "rank").select("event_id", F.col("new_rank").cast("long").alias("new_rank"))


# -- state and writes ----------------------------------------------------------------------------------

CHUNKS = "chunk as (select l_orderkey as note_id, l_linenumber as chunk_index, sha256(l_partkey || '|' || l_quantity::int) as content_hash, 'e' || l_suppkey as edge_id, l_discount, l_quantity, l_shipdate from lineitem)"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", "l_partkey", F.col("l_quantity").cast("int")), 256)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("chunk_index"), digest.alias("content_hash"), F.concat(F.lit("e"), "l_suppkey").alias("edge_id"), "l_discount", "l_quantity", "l_shipdate")


@query("s7_compiled_state", f"""with {CHUNKS} select o_orderkey as note_id, o_orderstatus as source_hash, coalesce(sha256(string_agg(content_hash, ',' order by chunk_index, content_hash)), sha256('')) as chunks, coalesce(string_agg(distinct edge_id, ',' order by edge_id), '') as edges
from orders left join chunk on note_id = o_orderkey group by 1, 2""")
def compiled_state(spark, sf):
    notes, chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_orderstatus").alias("source_hash")), _chunks(spark, sf)
    state = records.compiled_state(notes, chunks, chunks)
    return state.select("note_id", "source_hash", F.sha2(F.array_join("chunk_hashes", ","), 256).alias("chunks"), F.array_join("edge_ids", ",").alias("edges"))


NEW = f"{CHUNKS}, fresh as (select note_id, chunk_index, case when l_quantity > 40 then sha256(content_hash) else content_hash end as content_hash from chunk where l_shipdate >= timestamp '1999-01-01')"


@query("s8_upsert", f"""with {NEW}, carried as (select f.note_id, f.chunk_index, f.content_hash, max(c.l_discount) as embedding from fresh f left join chunk c using (note_id, chunk_index, content_hash) group by 1, 2, 3)
select note_id, chunk_index, content_hash, embedding from carried union all select note_id, chunk_index, content_hash, l_discount from chunk where note_id not in (select note_id from fresh)""")
def upsert(spark, sf):
    stored = _chunks(spark, sf).select("note_id", "chunk_index", "content_hash", F.col("l_discount").alias("embedding"), "l_quantity", "l_shipdate")
    changed = F.when(F.col("l_quantity") > 40, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))
    fresh = stored.where("l_shipdate >= timestamp '1999-01-01'").select("note_id", "chunk_index", changed.alias("content_hash"))
    stored = stored.select("note_id", "chunk_index", "content_hash", "embedding")
    return records.replaced(stored, records.carried_embeddings(fresh, stored).select(stored.columns))


@query("s9_removed_paths", f"with {CHUNKS} select note_id, chunk_index from chunk where note_id not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def removed_paths(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("note_id"))
    return records.without(_chunks(spark, sf), gone, "note_id").select("note_id", "chunk_index")


@query("s11_change_log", "select event_id, 9000 + row_number() over (order by ts, event_id) as sequence from events where event_type = 'signup'")
def change_log(spark, sf):
    return records.with_sequence(table(spark, sf, "events").where("event_type = 'signup'"), 9000, ["ts", "event_id"]).select("event_id", F.col("sequence").cast("long").alias("sequence"))


@query("s12_access_counters", "select user_id, count(*) as access_count, max(event_id) as last_accessed_at from events group by 1")
def access_counters(spark, sf):
    return records.access_counters(table(spark, sf, "events"), "user_id", "event_id")


@query("s13_hard_delete", "select 'customer' as t, count(*) as n from customer where c_acctbal >= 0 union all select 'orders', count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0))")
def hard_delete(spark, sf):
    c, o, li = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    gone = c.where("c_acctbal < 0").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    lines = o.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    left = [("customer", records.without(c, gone, "c_custkey")), ("orders", records.without(o, gone, "o_custkey")), ("lineitem", records.without(li, lines, "l_orderkey"))]
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t, d in left]
    return parts[0].union(parts[1]).union(parts[2])


@query("c6_change_kind", """with w as (select doc_id, doc_id % 5 > 0 as existed, case when n_chars % 3 = 0 then 'active' else 'draft' end as was, case lang when 'de' then 'superseded' when 'fr' then 'archived' else 'active' end as status, doc_id % 2 = 0 as same from documents)
select doc_id, case when not existed then 'created' when was <> status and status = 'superseded' then 'superseded' when was <> status and status = 'archived' then 'archived' when not same then 'updated' end as change from w""")
def change_kind(spark, sf):
    d = table(spark, sf, "documents")
    key, digest = F.col("doc_id"), F.sha2("text", 256)
    was, status = F.when(F.col("n_chars") % 3 == 0, "active").otherwise("draft"), F.when(F.col("lang") == "de", "superseded").when(F.col("lang") == "fr", "archived").otherwise("active")
    return d.select("doc_id", records.change_kind(key % 5 > 0, was, status, F.when(key % 2 == 0, digest).otherwise(F.lit("")), digest).alias("change"))


@query("t5_job_states", """with j as (select event_id, case event_type when 'view' then 'QUEUED' when 'click' then 'RUNNING' when 'signup' then 'RETRYING' when 'purchase' then 'SUCCEEDED' else 'FAILED' end as status, user_id % 3 as attempts, value > 5 as ended, value > 30 as failed from events)
select event_id, (status in ('SUCCEEDED', 'FAILED')) = ended and (status = 'FAILED') = failed and (status = 'QUEUED' or attempts > 0) as consistent from j""")
def job_states(spark, sf):
    kinds = {"view": "QUEUED", "click": "RUNNING", "signup": "RETRYING", "purchase": "SUCCEEDED", "error": "FAILED"}
    status = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    ended, error = F.when(F.col("value") > 5, F.col("ts")), F.when(F.col("value") > 30, F.col("props"))
    return table(spark, sf, "events").select("event_id", records.consistent_status(status, F.col("user_id") % 3, ended, error).alias("consistent"))


@query("t5_latest_status", "select user_id as job, event_type as status from events qualify row_number() over (partition by user_id order by value desc, event_id desc, event_type) = 1")
def latest_status(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("job"), "value", "event_id", F.col("event_type").alias("status"))
    return records.latest_status(log, "job", "value", "event_id", "status").select("job", "status")


@query("t2_deduplicated_submissions", "select user_id, event_type, count(*) as submitted, min(event_id) as kept from events group by 1, 2")
def deduplicated_submissions(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("submitted"), F.min("event_id").alias("kept"))


@query("q16_artifact_drift", """with r as (select p_partkey as name, p_name || p_size as digest from part where p_size <= 45), m as (select p_partkey as name, p_name || case when p_type = 'ECONOMY' then 0 else p_size end as digest from part where p_size >= 5)
select name, case when m.digest is null then 'missing_in_mirror' when r.digest is null then 'missing_in_repository' when r.digest <> m.digest then 'hash_mismatch' end as reason from r full join m using (name)""")
def artifact_drift(spark, sf):
    p = table(spark, sf, "part").withColumn("name", F.col("p_partkey"))
    mine = p.where("p_size <= 45").select("name", F.concat("p_name", "p_size").alias("digest"))
    theirs = p.where("p_size >= 5").select("name", F.concat("p_name", F.when(F.col("p_type") == "ECONOMY", 0).otherwise(F.col("p_size"))).alias("digest"))
    return records.artifact_drift(mine, theirs)


@query("q9_overall_status", """select o_orderkey, case when o_orderpriority like '1%' then 'RECOVERING' when o_orderstatus = 'F' then case when o_totalprice > 100000 or o_custkey % 2 = 0 then 'READY_WITH_WARNINGS' else 'READY' end when o_orderpriority like '2%' then 'DEGRADED' else 'NOT_READY' end as overall from orders""")
def overall_status(spark, sf):
    status = F.when(F.col("o_orderpriority").startswith("1"), "RECOVERING").when(F.col("o_orderpriority").startswith("2"), "VERIFYING").otherwise("READY")
    integrity = F.when(F.col("o_custkey") % 2 == 0, "DEGRADED").otherwise("HEALTHY")
    return table(spark, sf, "orders").select("o_orderkey", records.overall_status(status, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, integrity).alias("overall"))


@query("l19_current_compacts", "select o_orderkey as id, case when row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1 then 'CURRENT' else 'SUPERSEDED' end as status from orders")
def current_compacts(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("updated_at"))
    return records.current_per_project(c).select("id", "status")


@query("s6_record_lookup", "select o_orderkey from orders where o_orderstatus = 'O' and o_custkey = (select min(c_custkey) from customer) union all select o_orderkey from orders where o_orderkey in (7, 11)")
def record_lookup(spark, sf):
    o = table(spark, sf, "orders")
    first = table(spark, sf, "customer").agg(F.min("c_custkey").alias("o_custkey"))
    return filters.all_of(o, o_orderstatus="O").join(first, "o_custkey", "left_semi").select("o_orderkey").union(filters.all_of(o, o_orderkey=[7, 11]).select("o_orderkey"))
