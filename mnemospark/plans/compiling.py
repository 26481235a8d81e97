"""Queries of compiling, manifests, identities, linkage and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import calendar, linkage, manifest, reconcile, rows
from mnemospark.plans import queries as base
from mnemospark.plans import upkeep
from mnemospark.plans.registry import query
from mnemospark.session import table
from mnemospark.sources import markdown

# -- compile: orders as notes, their lines as chunks, suppliers as link targets ---------------------------

STATES = """line as (select l_orderkey as path, l_returnflag, l_shipdate, l_discount, 'e' || l_suppkey as edge, sha256(l_partkey || '|' || l_quantity::int) as h, l_linenumber, l_partkey from lineitem),
cur as (select path, row_number() over (partition by path order by l_linenumber, l_partkey, h) - 1 as i, case when l_discount > 0.08 then sha256(h) else h end as h, edge from line where l_returnflag <> 'R'),
old as (select path, row_number() over (partition by path order by l_linenumber, l_partkey, h) - 1 as i, h, edge from line where l_shipdate < timestamp '2000-01-01'),
c as (select path, sha256(string_agg(h, ',' order by i)) as h, o_orderstatus = 'F' as fresh from cur join orders on o_orderkey = path group by 1, o_orderstatus),
p as (select path, sha256(string_agg(h, ',' order by i)) as oh, o_orderpriority = '5-LOW' as bare from old join orders on o_orderkey = path group by 1, o_orderpriority)"""


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    digest = F.sha2(F.concat_ws("|", "l_partkey", F.col("l_quantity").cast("int")), 256)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), "l_returnflag", "l_shipdate", "l_discount", "l_linenumber", "l_partkey", F.concat(F.lit("e"), "l_suppkey").alias("edge"), digest.alias("h"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus", "o_orderpriority")

    def lists(name: str, kept, content) -> list:
        line = F.when(kept, F.struct("l_linenumber", "l_partkey", "h", content.alias("c")))
        return [F.transform(F.array_sort(F.collect_list(line)), lambda x: x["c"]).alias(f"{name}_chunks"), F.collect_set(F.when(kept, F.col("edge"))).alias(f"{name}_edges")]

    shown = F.when(F.col("l_discount") > 0.08, F.sha2("h", 256)).otherwise(F.col("h"))
    both = li.groupBy("path").agg(*lists("now", F.col("l_returnflag") != "R", shown), *lists("then", F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp"), F.col("h"))).join(o, "path")

    def side(name: str) -> DataFrame:
        rows = both.where(F.size(f"{name}_chunks") > 0).select("path", F.col(f"{name}_chunks").alias("chunks"), F.col(f"{name}_edges").alias("edges"), "o_orderstatus", "o_orderpriority")
        return rows.withColumn("source_hash", F.sha2(F.array_join("chunks", ","), 256))

    now, then = side("now"), side("then")
    now = now.withColumn("fingerprint", F.when(F.col("o_orderstatus") == "F", "new").otherwise("old"))
    return now, then.withColumn("fingerprint", F.lit("old")).withColumn("chunks", F.when(F.col("o_orderpriority") != "5-LOW", F.col("chunks")))


@query("c1_compile_plan", f"""with {STATES}, moved as (select cur.path, max((old.h is null or old.h <> cur.h)::int) = 1 as changed from cur left join old on old.path = cur.path and old.i = cur.i group by 1)
select path, case when h is null then 'REMOVED' when oh is null then 'ADDED' when h = oh and (bare or fresh) then 'EMBEDDING_ONLY' when h <> oh then 'UPDATED' end as action,
 case when h is null then 'REMOVE' when oh is null then 'DOCUMENT_ADDED' when h = oh and bare then 'CHUNKS_CHANGED' when h = oh and fresh then 'EMBEDDING_POLICY_CHANGED' when h <> oh and (bare or changed) then 'CHUNKS_CHANGED' else 'NONE' end as embedding
from c full join p using (path) left join moved using (path) where action is not null""")
def compile_plan(spark, sf):
    return rows.compile_plan(*_states(spark, sf))


@query("c1_chunk_actions", f"with {STATES} select cur.path, cur.i::int as chunk_index, case when old.h is null then 'ADD' when old.h = cur.h then 'KEEP' else 'UPDATE' end as action from cur left join (select old.* from old join orders on o_orderkey = path where o_orderpriority <> '5-LOW') old on old.path = cur.path and old.i = cur.i")
def chunk_actions(spark, sf):
    return manifest.chunk_actions(*_states(spark, sf))


@query("c1_edge_actions", f"with {STATES}, a as (select distinct path, edge from cur), b as (select distinct path, edge, true as had from old) select path, edge as edge_id, case when b.had is null then 'ADD' when a.path is null then 'REMOVE' else 'KEEP' end as action from (select path, edge, true as has from a) a full join b using (path, edge)".replace("a.path is null", "a.has is null"))
def edge_actions(spark, sf):
    return manifest.edge_actions(*_states(spark, sf))


@query("c1_plan_fingerprint")
def plan_fingerprint(spark, sf):
    return manifest.plan_fingerprint(rows.compile_plan(*_states(spark, sf)))


CANDIDATES = """cand as (select o_orderkey as ordinal, 'n' || case when o_orderkey % 97 = 1 then o_orderkey - 1 else o_orderkey end as note_id, 'f/' || o_orderkey as relative_path, 'f/' || case when o_orderkey % 101 = 2 then o_orderkey - 1 else o_orderkey end as canonical_path, o_orderpriority <> '5-LOW' as is_context, o_custkey || '|' || o_orderdate::date as identity,
  case when o_orderkey % 640 = 0 then 'n' || (o_orderkey + 60) when o_orderkey % 4 = 0 and o_orderkey % 64 <> 0 then 'n' || (o_orderkey - 4) when o_orderkey % 118 = 5 then 'n' || (o_orderkey - 1) end as supersedes,
  case when o_orderkey % 52 = 0 then 'n' || (o_orderkey + 5) when o_orderkey % 28 > 0 and o_orderkey % 4 = 0 and (o_orderkey + 4) % 64 <> 0 then 'n' || (o_orderkey + 4) end as superseded_by from orders)"""


@query("c2_manifest", f"""with recursive {CANDIDATES}, s1 as (select *, count(*) over (partition by canonical_path) > 1 as clash from cand), s2 as (select *, first(relative_path) over w as fp, row_number() over w as r from s1 where not clash window w as (partition by note_id order by ordinal)),
s3 as (select *, case when is_context then row_number() over w end as q, first(relative_path) over w as gp from s2 where r = 1 window w as (partition by is_context, identity order by ordinal)),
v as (select * from s3 where not is_context or q = 1), x as (select ordinal, note_id, supersedes as t, superseded_by as b from v where is_context),
y as (select x.*, k.note_id is not null as there, k.b as back, k.note_id is not null and (k.b is null or k.b = x.note_id) as fits, m.note_id is not null as rep, m.t as forth from x left join x k on k.note_id = x.t left join x m on m.note_id = x.b),
z as (select *, min(case when fits then ordinal end) over (partition by t) as taker from y), named as (select z.*, tk.note_id as taker_id from z left join x tk on tk.ordinal = taker),
walk as (select note_id as start, t as cur, 1 as n from x where t in (select note_id from x) union all select start, x.t, n + 1 from walk join x on x.note_id = cur where n < 20 and x.t in (select note_id from x)),
loops as (select distinct start from walk where start = cur),
why as (select ordinal, note_id, t, case when note_id in (from loops) then 'cycle' when t is not null and not there then 'absent:' || t when t is not null and taker < ordinal then 'replaced:' || taker_id when t is not null and not fits then 'backlink:' || back
  when b is not null and not rep then 'no_replacement:' || b when b is not null and forth is distinct from note_id then 'not_reciprocal:' || b end as w from named),
bad as (select note_id from why where w is not null union select why.note_id from why join bad on why.t = bad.note_id)
select ordinal, 'DUPLICATE_CANONICAL_PATH' as code, canonical_path as detail from s1 where clash union all select ordinal, 'DUPLICATE_CONTEXT_ID', fp from s2 where r > 1 union all select ordinal, 'DUPLICATE_CONTEXT_CONTENT', gp from s3 where q > 1
union all select ordinal, case when note_id in (from bad) then 'INVALID_SUPERSEDE' end, coalesce(w, case when note_id in (from bad) then 'absent:' || t end) from why union all select ordinal, null, null from v where not is_context""")
def validate_manifest(spark, sf):
    k, n = F.col("o_orderkey"), F.lit("n")
    supersedes = F.when(k % 640 == 0, F.concat(n, k + 60)).when((k % 4 == 0) & (k % 64 != 0), F.concat(n, k - 4)).when(k % 118 == 5, F.concat(n, k - 1))
    by = F.when(k % 52 == 0, F.concat(n, k + 5)).when((k % 28 > 0) & (k % 4 == 0) & ((k + 4) % 64 != 0), F.concat(n, k + 4))
    c = table(spark, sf, "orders").select(
        k.alias("ordinal"), F.concat(n, F.when(k % 97 == 1, k - 1).otherwise(k)).alias("note_id"), F.concat(F.lit("f/"), k).alias("relative_path"), F.concat(F.lit("f/"), F.when(k % 101 == 2, k - 1).otherwise(k)).alias("canonical_path"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_context"), F.concat_ws("|", "o_custkey", F.to_date("o_orderdate")).alias("identity"), supersedes.alias("supersedes"), by.alias("superseded_by"),
    )
    return manifest.validate_manifest(c)


COMPARED = "case when {c}1 is null then 'not_compared' when {c}0 is null then 'missing_previous' when {c}0 = {c}1 then 'unchanged' else 'changed' end"


@query("c3_change_report", f"""with {STATES}, n as (select path, sha256(string_agg(h, ',' order by i)) as v, list_sort(list_distinct(list(h))) as k, list_sort(list_distinct(list(edge))) as e from cur group by 1),
o as (select path, sha256(string_agg(h, ',' order by i)) as v, list_sort(list_distinct(list(h))) as k, list_sort(list_distinct(list(edge))) as e from old group by 1),
b as (select path, o.v as h0, n.v as h1, case when o.v is not null then 'old' end as f0, case when n.v is null then null when o_orderstatus = 'F' then 'new' else 'old' end as f1,
  case when o_orderpriority <> '5-LOW' then o.k end as k0, n.k as k1, o.e as e0, n.e as e1 from n full join o using (path) join orders on o_orderkey = path),
s as (select path, {COMPARED.format(c="h")} as content, {COMPARED.format(c="f")} as fingerprint, {COMPARED.format(c="k")} as chunks, {COMPARED.format(c="e")} as edges from b)
select *, 'changed' in (content, fingerprint, chunks, edges) as any_changed, 'changed' in (content, fingerprint, chunks, edges) or 'missing_previous' in (content, fingerprint, chunks, edges) as requires_refresh from s""")
def change_report(spark, sf):
    now, then = _states(spark, sf)
    side = lambda df, i: df.select("path", *[F.col(c).alias(f"{k}{i}") for k, c in {"h": "source_hash", "f": "fingerprint", "k": "chunks", "e": "edges"}.items()])
    both = side(then, 0).join(side(now, 1), "path", "full_outer")
    out = manifest.change_report(both, {"content": ("h0", "h1"), "fingerprint": ("f0", "f1")}, {"chunks": ("k0", "k1"), "edges": ("e0", "e1")})
    return out.select("path", "content", "fingerprint", "chunks", "edges", "any_changed", "requires_refresh")


@query("c4_identity", """with n as (select o_orderkey as note_id, o_orderpriority as project, o_orderstatus as report, o_orderdate::date::varchar as date, o_custkey as entity, o_orderpriority || '/' || o_orderstatus || '/' || o_orderdate::date || '-x' || o_custkey || '-' || o_orderkey || '.md' as path from orders),
r as (select o_custkey as entity, o_orderpriority as project, o_orderstatus as report, max(o_orderdate::date)::varchar as date, count(*) as c from orders group by 1, 2, 3), q as (select *, case when entity % 3 = 0 then (date::date + 1)::date::varchar else date end as want from r),
hit as (select q.entity, q.project, q.report, q.want, count(n.note_id) as k, min(n.note_id) as id, arg_min(n.path, n.note_id) as path from q left join n on n.entity = q.entity and n.project = q.project and n.report = q.report and n.date = q.want group by 1, 2, 3, 4),
sib as (select q.entity, q.project, q.report, max(n.date) as d from q join n on n.entity = q.entity and n.project = q.project and n.report = q.report and n.date < q.want group by 1, 2, 3), one as (select s.entity, s.project, s.report, s.d, count(*) as k, min(n.path) as path from sib s join n on n.entity = s.entity and n.project = s.project and n.report = s.report and n.date = s.d group by 1, 2, 3, 4)
select h.project || h.report || h.entity as request, case when h.k = 1 then 'EXISTING_CANONICAL_FAMILY' when h.k > 1 then 'AMBIGUOUS_CANONICAL_IDENTITY' else 'NEW_CANONICAL_IDENTITY' end as resolution, case when h.k = 1 then h.path when one.k = 1 then replace(one.path, one.d, h.want) else h.project || '/' || h.report || '/' || h.want || '-' || h.entity || '.md' end as path
from hit h left join one using (entity, project, report)""")
def identity(spark, sf):
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate").cast("string"))
    path = F.concat(F.concat_ws("/", "o_orderpriority", "o_orderstatus", "date"), F.lit("-x"), F.concat_ws("-", "o_custkey", "o_orderkey"), F.lit(".md"))
    none = F.lit(None).cast("string")
    notes = o.select(F.col("o_orderkey").alias("note_id"), path.alias("path"), F.col("o_orderpriority").alias("project"), F.lit("zz").alias("report"), F.array("o_orderstatus").alias("aliases"), "date", F.col("o_custkey").cast("string").alias("entity"), none.alias("edition"))
    last = o.groupBy("o_orderpriority", "o_orderstatus", "o_custkey").agg(F.max("date").alias("last"))
    want = F.when(F.col("o_custkey") % 3 == 0, F.date_add(F.col("last").cast("date"), 1).cast("string")).otherwise(F.col("last"))
    asked = last.select(F.concat("o_orderpriority", "o_orderstatus", "o_custkey").alias("request"), F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("report"), want.alias("date"), F.col("o_custkey").cast("string").alias("entity"), none.alias("edition"))
    return manifest.resolve_identity(asked, notes).select("request", "resolution", "path")


@query("s10_rendered_notes", "select p_partkey, sha256('---' || chr(10) || 'p_name: ' || p_name || chr(10) || 'p_size: ' || p_size || chr(10) || '---' || chr(10) || chr(10) || p_type) as digest from part")
def rendered_notes(spark, sf):
    p = table(spark, sf, "part").withColumn("relative_path", F.col("p_partkey").cast("string"))
    return markdown.rendered(p, ["p_name", "p_size"], "p_type").select(F.col("relative_path").cast("long").alias("p_partkey"), F.sha2("text", 256).alias("digest"))


TRICKY = """case p_partkey % 8 when 0 then 'true' when 1 then '12' when 2 then p_name || ': x' when 3 then '''q''' when 4 then '[a, b]' when 5 then '- item' when 6 then ' ' || p_name else p_name end"""


@query("s10_round_trip", f"""with p as (select p_partkey, {TRICKY} as t, * exclude (p_partkey) from part), e as (select p_partkey, unnest([{{'key': 'title', 'kind': 'string', 'v': t}}, {{'key': 'size', 'kind': 'integer', 'v': p_size::varchar}}, {{'key': 'tags', 'kind': 'list', 'v': p_type || '|' || t}},
  {{'key': 'none', 'kind': 'list', 'v': ''}}, {{'key': 'gone', 'kind': 'null', 'v': '-'}}, {{'key': 'done', 'kind': 'boolean', 'v': 'true'}}]) as x from p) select p_partkey, x.key as key, x.kind as kind, x.v as value from e""")
def round_trip(spark, sf):
    """Notes are rendered and read again."""
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 8
    tricky = F.when(k == 0, "true").when(k == 1, "12").when(k == 2, F.concat("p_name", F.lit(": x"))).when(k == 3, "'q'").when(k == 4, "[a, b]").when(k == 5, "- item").when(k == 6, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    rows = p.select(F.col("p_partkey").cast("string").alias("relative_path"), tricky.alias("title"), F.col("p_size").alias("size"), F.array(F.col("p_type"), tricky).alias("tags"), F.array().cast("array<string>").alias("none"), F.lit(None).cast("int").alias("gone"), F.lit(True).alias("done"), "p_type")
    n = markdown.notes(markdown.rendered(rows, ["title", "size", "tags", "none", "gone", "done"], "p_type")).select("relative_path", F.explode("frontmatter").alias("e"))
    value = F.array_join(F.transform("e.values", lambda x: F.coalesce(x, F.lit("-"))), "|")
    return n.select(F.col("relative_path").cast("long").alias("p_partkey"), "e.key", "e.kind", value.alias("value"))


# -- linkage -------------------------------------------------------------------------------------------


NAMED = base.MET.replace("met as (", "near as (") + """,
named as (select vec_id as x, vec_id - 1 as y from embeddings union all select vec_id, vec_id % 2 from embeddings where label % 2 = 0),
met as (from near union select least(x, y), greatest(x, y) from named where x <> y and y in (select vec_id from embeddings))"""


@query("l1_evidence", f"""with {NAMED}, pairs as ({base.SCORED}),
e as (select score >= 0.3 as near, left_label % 2 = 0 and right_label % 2 = 0 and left_id % 2 = right_id % 2 as linked, right_id - left_id = 1 as descends, left_label = right_label as same_label from pairs)
select case when near then 'vector_similarity,' else '' end || 'temporal_overlap' || case when linked then ',graph_neighborhood' else '' end || case when descends then ',lineage_structure' else '' end as reasons, same_label, count(*) as n
from e where near or linked or descends group by 1, 2""")
def evidence(spark, sf):
    k, vectors = F.col("vec_id"), table(spark, sf, "embeddings")
    items = vectors.select(
        k.alias("item_id"), F.lit(None).cast("string").alias("content_hash"), "embedding", F.array(F.col("label").cast("string")).alias("blocks"),
        F.when(F.col("label") % 2 == 0, F.array(k % 2)).otherwise(F.array().cast("array<bigint>")).alias("neighbours"), F.array(k - 1).alias("ancestors"),
    )
    pairs = linkage.candidate_pairs(items, vector=0.3, max_block=None, digits=6)
    label = lambda side: vectors.select(k.alias(f"{side}_id"), F.col("label").alias(side))
    both = pairs.join(label("left"), "left_id").join(label("right"), "right_id")
    return both.groupBy(F.array_join("reasons", ",").alias("reasons"), (F.col("left") == F.col("right")).alias("same_label")).agg(F.count(F.lit(1)).alias("n"))


@query("l3_capped_pairs")
def capped_pairs(spark, sf):
    return linkage.capped(base._linked(spark, sf).select("left_id", "right_id", "score"), 5).select("left_id", "right_id")


@query("l5_lineage", """with x as (select o_orderkey as id, o_custkey, row_number() over w as n, list_filter([lag(o_orderkey, 1) over w, lag(o_orderkey, 3) over w], lambda i: i is not null) as above from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
p as (select case when a.id % 2 = 0 then a else b end as l, case when a.id % 2 = 0 then b else a end as r from x a join x b on a.o_custkey = b.o_custkey and b.n - a.n between 1 and 3)
select l.id as left_id, r.id as right_id, case when list_contains(l.above, r.id) then 'left_descends_from_right' when list_contains(r.above, l.id) then 'right_descends_from_left' when len(list_intersect(l.above, r.above)) > 0 then 'shared_ancestor' else 'none' end as lineage from p""")
def lineage(spark, sf):
    """Each order with the next three of its customer; an order descends from the one before it and the third before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    above = F.array_compact(F.array(F.lag("o_orderkey", 1).over(w), F.lag("o_orderkey", 3).over(w)))
    x = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.struct(F.col("o_orderkey").alias("item_id"), above.alias("ancestors")).alias("a"))
    pairs = x.select("a", F.array_compact(F.array(*[F.lead("a", i).over(w) for i in (1, 2, 3)])).alias("later")).select("a", F.explode("later").alias("b"))
    even = F.col("a.item_id") % 2 == 0
    pairs = pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("l"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("r"))
    return pairs.select(F.col("l.item_id").alias("left_id"), F.col("r.item_id").alias("right_id"), linkage.lineage(F.col("l"), F.col("r")).alias("lineage"))


PLANS = f"""{upkeep.DECIDED}, cand as (select l_orderkey as o, l_linenumber as candidate from lineitem), plan as (select c.o, c.candidate, relation, coalesce(relation in ('CONTRADICTS', 'SUPERSEDES', 'UNKNOWN'), false) as review from cand c left join chosen using (o, candidate))"""


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    first = reconcile.primary_decisions(upkeep._decisions(spark, sf), ["o", "candidate"], [F.asc("existing")])
    all_ = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("candidate"))
    return reconcile.plan(all_.join(first, ["o", "candidate"], "left"), [F.col("o"), F.col("candidate")], F.col("o") % 2 == 0)


@query("l8_model_gate", """with e as (select event_id, case when user_id % 2 = 0 then 'UNKNOWN' else 'EXTENDS' end as base, ['UNRELATED', 'DUPLICATE', 'SUPPORTS', 'EXTENDS', 'CONTRADICTS', 'SUPERSEDES', 'UNKNOWN'][event_id % 7 + 1] as p, (event_id % 40) / 40.0 as sure, (event_id % 11) / 11.0 as sem, (event_id % 13) / 13.0 as claim, event_id % 3 as scope, event_id % 2 as pol, event_id % 5 > 1 as meets from events),
f as (select *, base = 'UNKNOWN' and p <> 'UNKNOWN' and sure >= 0.65 and case when p = 'UNRELATED' then sure >= 0.85 and sem < 0.5 when scope = 0 then false when p = 'DUPLICATE' then greatest(sem, claim) >= 0.85 when p = 'SUPPORTS' then claim >= 0.65 and pol = 0 when p = 'EXTENDS' then claim >= 0.5 and pol = 0 when p = 'CONTRADICTS' then meets and pol = 1 when p = 'SUPERSEDES' then not meets else false end as taken from e)
select event_id, case when taken then p else base end as relation, case when taken then 'llm' else 'deterministic' end as source from f""")
def model_gate(spark, sf):
    k = F.col("event_id")
    kinds = F.array(*map(F.lit, ["UNRELATED", "DUPLICATE", "SUPPORTS", "EXTENDS", "CONTRADICTS", "SUPERSEDES", "UNKNOWN"]))
    proposal = F.struct(F.element_at(kinds, (k % 7 + 1).cast("int")).alias("relation"), ((k % 40) / 40.0).alias("confidence"))
    meets = k % 5 > 1
    scores = F.struct(((k % 11) / 11.0).alias("semantic"), ((k % 13) / 13.0).alias("claim"), (k % 3).alias("scope"), (k % 2).alias("polarity_conflict"), meets.cast("int").alias("temporal"))
    v = reconcile.with_proposal(F.when(F.col("user_id") % 2 == 0, "UNKNOWN").otherwise("EXTENDS"), F.lit(0.45), proposal, scores, overlapping=meets, newer=F.lit(True))
    return table(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", "v.relation", "v.source")


@query("l11_plans", f"with {PLANS} select o, candidate, case when review then 'REVIEW_REQUIRED' else 'PLANNED' end as status, (case when o % 2 = 1 then 1 else 0 end + case when relation is null or review then 1 else 0 end)::int as warnings, sha256(o || '|' || candidate) as idempotency_key from plan")
def plans(spark, sf):
    return _plans(spark, sf).select("o", "candidate", "status", F.size("warnings").alias("warnings"), "idempotency_key")


@query("l12_linkage_recall", f"with {base.PAIRS}, b as (select left_id as item, right_id as other, score from pairs where score >= 0.3 union all select right_id, left_id, score from pairs where score >= 0.3) select item, other, row_number() over (partition by item order by score desc, other) as place from b qualify place <= 3")
def linkage_recall(spark, sf):
    return linkage.near_neighbours(base._labelled(spark, sf), 0.3, 3).select("item", "other", "place")


@query("l13_sweep", f"with {PLANS} select count(*) as scanned, count(relation) as planned, count(*) filter (review) as review, count(*) filter (relation = 'UNRELATED') as unrelated, count(*) - count(distinct o || '|' || candidate) as repeated from plan")
def sweep(spark, sf):
    return reconcile.sweep_counters(_plans(spark, sf))


@query("l14_buckets", f"""with {PLANS}, b as (select unnest([case when coalesce(relation not in ('DUPLICATE', 'CONTRADICTS', 'SUPERSEDES'), true) and not review then 'retained' end, case relation when 'DUPLICATE' then 'duplicates' when 'SUPERSEDES' then 'supersession' when 'CONTRADICTS' then 'contradictions' end,
  case when relation is null or relation in ('SUPPORTS', 'EXTENDS') then 'summary' end, case when relation in ('SUPPORTS', 'EXTENDS') then 'relations' end, case when review then 'review' end]) as bucket from plan),
k as (select unnest(['retained', 'duplicates', 'supersession', 'contradictions', 'summary', 'relations', 'review']) as bucket) select k.bucket, count(b.bucket) as n from k left join b using (bucket) group by 1""")
def buckets(spark, sf):
    return reconcile.cycle_buckets(_plans(spark, sf))


FACTS = """fact as (select o_orderkey as context_id, case when o_orderkey % 11 = 0 then 'OPEN_CONFLICT' when o_orderkey % 7 = 0 then 'UNCERTAIN' when o_orderstatus = 'F' then 'SUPERSEDED' when o_orderstatus = 'O' then 'CURRENT' when o_orderkey % 2 = 0 then 'HISTORICAL' else 'UNCERTAIN' end as category from orders)"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    none = F.array().cast("array<string>")
    conflicts, by, to = F.when(k % 11 == 0, F.array(F.lit("x"))).otherwise(none), F.when(status == "F", "n"), F.when(k % 2 == 0, F.col("o_orderdate"))
    category = reconcile.fact_category(conflicts, k % 7 != 0, by, status == "O", to)
    return table(spark, sf, "orders").select(k.alias("context_id"), category.alias("category"), F.concat(F.lit("Total  "), k).alias("content"), F.when(k % 5 == 0, none).otherwise(F.array(F.lit("e"))).alias("evidence"), conflicts.alias("conflicts"), to.alias("valid_to"), by.alias("superseded_by"))


@query("l15_fact_categories", f"with {FACTS} select * from fact")
def fact_categories(spark, sf):
    return _facts(spark, sf).select("context_id", "category")


@query("l15_safety_issues", f"""with {FACTS}, f as (select o_orderkey as id, category, 'total ' || o_orderkey as t, o_orderkey % 5 > 0 as supported, o_orderkey % 11 = 0 as disputed, o_orderkey % 2 = 0 or o_orderstatus = 'F' as past from fact join orders on o_orderkey = context_id)
select 'TEMPORAL_STATE_COLLAPSE' as issue where exists (select 1 from f group by id having count(distinct category) > 1) union all select 'DUPLICATE_CLAIM_INFLATION' where exists (select 1 from f group by t having count(distinct id) > 1)
union all select 'UNSUPPORTED_MERGE' where exists (select 1 from f where category = 'CURRENT' and not supported) union all select 'SUPERSEDED_FACT_PRESENTED_AS_CURRENT' where exists (select 1 from f where category = 'CURRENT' and past)
union all select 'UNRESOLVED_CONTRADICTION_LEAKAGE' where exists (select 1 from f where category = 'CURRENT' and disputed)""")
def safety_issues(spark, sf):
    return reconcile.safety_issues(_facts(spark, sf))


@query("l17_name_ids", "with h as (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('memory:' || c_name)) as h from customer) select c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::int % 4) + 1, 1) || h[18:20] || '-' || h[21:32] as id from h")
def name_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", reconcile.name_id(F.concat(F.lit("memory:"), "c_name")).alias("id"))


@query("l18_compact_review", """with r as (select o_orderkey, case when o_orderkey % 3 = 0 then 0 else 2 end as dd, case when o_orderkey % 5 = 0 then 1 else 2 end as cs, 2 as rb, case when o_orderkey % 7 = 0 then 1 else 2 end as na, case o_orderkey % 4 when 0 then 0 when 1 then 1 else 2 end as ev, case when o_orderstatus = 'F' then 0 when o_orderstatus = 'O' then 1 else 2 end as iso, case when o_orderkey % 13 = 0 then 0 else 2 end as fr, 2 as con, case when o_orderkey % 6 = 0 then 0 else 2 end as ch from orders),
t as (select *, (dd + cs + rb + na + ev + iso + fr + con + ch + na)::int as total from r) select o_orderkey, total, case when fr = 0 or iso = 0 then 'BLOCKED' when total < 17 or ev < 2 or cs < 2 or iso < 2 then 'NEEDS_REVISION' else 'PASS' end as verdict, total = 20 as publishable from t""")
def compact_review(spark, sf):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    part = lambda head, text: F.concat(F.lit(f"## {head}\n"), text, F.lit("\n"))
    body = F.concat(
        F.lit("# Compact\n"), F.when(status == "F", "- project: other\n").when(status == "P", "project: atlas\n").otherwise(""), F.when(k % 3 == 0, "").otherwise(part("Durable Decisions", F.lit("we keep the index"))),
        part("Current State", F.when(k % 5 == 0, "all well").otherwise("all is well now")), part("Risks and Blockers", F.lit("none are known yet")), part("Next Actions", F.when(k % 7 == 0, "ship it").otherwise("ship it on Monday")),
    )
    c = table(spark, sf, "orders").select("o_orderkey", body.alias("body"), F.lit("Atlas").alias("project"), (k % 4 == 0).cast("int").alias("missing_refs"), (k % 4 == 1).cast("int").alias("unlinked_refs"), (k % 13 == 0).alias("stale"), (k % 6 == 0).alias("open_conflicts"))
    return reconcile.compact_review(c).select("o_orderkey", "total", "verdict", "publishable")


# -- calendar ------------------------------------------------------------------------------------------

MATRIX = """p as (select event_type as family, ts::date as day, min((ts + interval 3 hour)::date) as made from events where value > 1 group by 1, 2), grid as (select family, unnest(generate_series(timestamp '2023-12-18', timestamp '2024-02-29', interval 1 day))::date as day from (select distinct family from p)),
state as (select family, day, case when day >= date '2024-02-10' then 'OPEN' when dayofweek(day) in (0, 6) and family = 'error' then 'NOT_EXPECTED' when made is null then 'MISSING' when made > day then 'BACKFILL' else 'COMPLETE' end as state from grid left join p using (family, day))"""


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("value > 1").select(F.col("event_type").alias("family"), F.to_date("ts").alias("day"), (F.col("ts") + F.expr("interval 3 hours")).alias("created"))
    expected = ~(F.dayofweek("day").isin(1, 7) & (F.col("family") == "error"))
    return calendar.coverage(e, "2023-12-18", "2024-02-29", "2024-02-10", expected=expected)


@query("q1_closable_days", f"with {MATRIX} select strftime(day, '%Y-%m-%d') as day, count(*) filter (state in ('OPEN', 'MISSING')) = 0 as closable, count(*) filter (state = 'MISSING') as missing, count(*) filter (state = 'BACKFILL') as backfills from state group by 1")
def closable_days(spark, sf):
    return calendar.closable_days(_matrix(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("q2_packet_scan", "with e as (select event_type as family, case when event_id % 50 = 0 then 'soon' else strftime(ts, '%Y-%m-%d') end as d, ts from events), u as (select family, count(*) filter (d = 'soon') as unparsed from e group by 1) select family, d as day, strftime(min(ts) + interval 9 hour, '%Y-%m-%d') as created, unparsed from e join u using (family) where d <> 'soon' group by 1, 2, 4")
def packet_scan(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("family"), F.when(F.col("event_id") % 50 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.col("ts").cast("timestamp").alias("created_at"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return calendar.scan_packets(e, "Asia/Seoul").select("family", iso("day"), iso("created"), "unparsed")


@query("q4_closes_due", f"with {MATRIX}, w as (select family, 'week' as span, date_trunc('week', day)::date as first, count(*) as n, count(*) filter (state in ('OPEN', 'MISSING')) as gaps from state group by 1, 3 having n = 7 and gaps = 0), m as (select family, 'month' as span, date_trunc('month', day)::date as first, count(*) as n, count(*) filter (state in ('OPEN', 'MISSING')) as gaps from state group by 1, 3 having n = day(last_day(first)) and gaps = 0) select family, span, strftime(first, '%Y-%m-%d') as first from (select * from w union all select * from m)")
def closes_due(spark, sf):
    states = _matrix(spark, sf)
    week = calendar.weeks_due(states).select("family", F.lit("week").alias("span"), F.date_format("week", "yyyy-MM-dd").alias("first"))
    return week.union(calendar.months_due(states).select("family", F.lit("month").alias("span"), F.date_format("month", "yyyy-MM-dd").alias("first")))
