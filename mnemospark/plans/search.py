"""Queries of search: plans, variants, ranks, cascades, briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import briefs, filters, retrieval, search, text_index
from mnemospark.plans import index
from mnemospark.plans import queries as base
from mnemospark.operators.rows import with_running_sum
from mnemospark.plans.registry import query
from mnemospark.session import table

STOP = ", ".join(f"'{w}'" for w in sorted(search.STOP_WORDS))


@query("r10_query_variants", rf"""with s as (select conv_id, turn, unnest(regexp_split_to_array(text, '[,;\n.!?。]+')) as s, generate_subscripts(regexp_split_to_array(text, '[,;\n.!?。]+'), 1) as k from conversations),
w as (select conv_id, turn, k, list_filter(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1 and lower(x) not in ({STOP})) as w from s),
z as (select conv_id, turn, k, w, z.o as o, z.n as n, unnest(range(0, len(w) - z.n + 1)) as j from (select *, unnest([{{'o': 1, 'n': 4}}, {{'o': 2, 'n': 3}}, {{'o': 3, 'n': 2}}]) as z from w) where len(w) > z.n),
v as (select conv_id, turn, 0 as k, 0 as o, 0 as j, trim(regexp_replace(text, '\s+', ' ', 'g')) as v from conversations union all select conv_id, turn, k, 0, 0, array_to_string(w, ' ') from w
  union all select conv_id, turn, k, o, j, array_to_string(case j when 0 then w[1:n] when 1 then w[len(w) - n + 1:len(w)] else w[j:j + n - 1] end, ' ') from z),
f as (select conv_id, turn, v, min([k, o, j]) as p from v where v <> '' group by 1, 2, 3)
select conv_id, turn, (row_number() over (partition by conv_id, turn order by p) - 1)::int as place, v as variant from f qualify place < 16""")
def query_variants(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(search.variants(F.col("text"))).alias("place", "variant"))


@query("r11_first_variant", r"select doc_id, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])the'))::int as hits, 1 as variant from documents where regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the')")
def first_variant(spark, sf):
    return search.first_variant_matches(table(spark, sf, "documents"), "doc_id", "text", ["zzzzqqq the", "the", "of"])


@query("r12_overfetch", "select s_suppkey, least(50, greatest(s_suppkey, 6 * s_suppkey)) as candidates from supplier")
def overfetch(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", search.hybrid_limit(F.col("s_suppkey")).alias("candidates"))


def _plan_sql(source: str) -> str:
    has = {k: " or ".join(f"contains(f, '{m}')" for m in v) for k, v in search.MARKERS.items()}
    return f"""q as (select *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as f, regexp_matches(text, '\\b20\\d{{2}}-\\d{{2}}-\\d{{2}}\\b') as dated, len(regexp_extract_all(text, '{search.QUERY_TOKEN}')) as n from {source}),
t as (select *, n > 0 and not regexp_matches(text, '[?!。]') and not ({has['SEMANTIC']}) and (dated or n <= 8 and length(trim(text)) <= 96) as title from q),
planned as (select *, case when dated and title then 'EXACT_OR_TITLE' when {has['TEMPORAL_CURRENT_STATE']} then 'TEMPORAL_CURRENT_STATE' when {has['EXPERIENTIAL']} then 'EXPERIENTIAL' when {has['PROCEDURAL']} then 'PROCEDURAL' when {has['GRAPH_ORIENTED']} then 'GRAPH_ORIENTED'
  when title then 'EXACT_OR_TITLE' when contains(text, '?') or {has['SEMANTIC']} then 'SEMANTIC_PARAPHRASE' else 'MIXED' end as intent, {has['GRAPH_ORIENTED']} as g from t)"""


#: Queries made of names and phrases, some of them dated, asking or marked.
ASKED = """asked as (select p_partkey as id, case p_partkey % 9 when 0 then p_name when 1 then p_name || ' 2026-02-0' || (p_partkey % 9 + 1) when 2 then 'What is ' || p_name || '?' when 3 then 'the latest ' || p_name when 4 then 'How to  set ' || p_name when 5 then 'Root cause of ' || p_name
  when 6 then p_name || ' is related to ' || p_type when 7 then repeat(p_name || ' ', 9) else p_name || '! and more of it' end as text from part)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    text = (
        F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" 2026-02-0"), k + 1)).when(k == 2, F.concat(F.lit("What is "), name, F.lit("?"))).when(k == 3, F.concat(F.lit("the latest "), name))
        .when(k == 4, F.concat(F.lit("How to  set "), name)).when(k == 5, F.concat(F.lit("Root cause of "), name)).when(k == 6, F.concat(name, F.lit(" is related to "), "p_type"))
        .when(k == 7, F.repeat(F.concat(name, F.lit(" ")), F.lit(9))).otherwise(F.concat(name, F.lit("! and more of it")))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


@query("r15_planner", f"with {ASKED}, {_plan_sql('asked')} select id, intent, case when intent = 'EXACT_OR_TITLE' then 'FTS_ONLY' else 'HYBRID' end as strategy, intent <> 'EXACT_OR_TITLE' and g as graph, (case when intent = 'EXACT_OR_TITLE' then 5 else 30 end)::int as fts_budget, (case when intent <> 'EXACT_OR_TITLE' and g then 2 else 0 end)::int as graph_depth from planned")
def planner(spark, sf):
    return _asked(spark, sf).select("id", search.retrieval_plan(F.col("text"), F.lit(5)).alias("p")).select("id", "p.intent", "p.strategy", "p.graph", "p.fts_budget", "p.graph_depth")


@query("r15_planner_on_turns", f"with {_plan_sql('conversations')} select conv_id, turn, intent from planned")
def planner_on_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", search.retrieval_plan(F.col("text"), F.lit(5))["intent"].alias("intent"))


@query("r16_execution", f"with {ASKED}, {_plan_sql('asked')} select id, case when id % 2 = 1 then 'VECTOR_ONLY' when intent = 'EXACT_OR_TITLE' then 'FTS_ONLY' else 'HYBRID' end as strategy, id % 2 = 1 or (intent <> 'EXACT_OR_TITLE' and g) as graph, (case when id % 2 = 1 then 20 when intent = 'EXACT_OR_TITLE' then 5 else 20 end)::int as budget from planned")
def execution(spark, sf):
    asked = F.when(F.col("id") % 2 == 1, "VECTOR_ONLY").otherwise("AUTO")
    e = search.execution(asked, search.retrieval_plan(F.col("text"), F.lit(5)), F.lit(5), F.lit(20))
    return _asked(spark, sf).select("id", e.alias("e")).select("id", "e.strategy", "e.graph", "e.budget")


@query("q12_planner_accuracy", f"with {ASKED}, {_plan_sql('asked')} select id % 9 as kind, count(*) as n, round(avg((intent = case id % 9 when 0 then 'EXACT_OR_TITLE' when 1 then 'EXACT_OR_TITLE' when 2 then 'SEMANTIC_PARAPHRASE' when 3 then 'TEMPORAL_CURRENT_STATE' when 4 then 'PROCEDURAL' when 5 then 'EXPERIENTIAL' when 6 then 'GRAPH_ORIENTED' else 'MIXED' end)::int), 6) as accuracy from planned group by 1")
def planner_accuracy(spark, sf):
    want = F.element_at(F.array(*map(F.lit, ["EXACT_OR_TITLE", "EXACT_OR_TITLE", "SEMANTIC_PARAPHRASE", "TEMPORAL_CURRENT_STATE", "PROCEDURAL", "EXPERIENTIAL", "GRAPH_ORIENTED", "MIXED", "MIXED"])), (F.col("id") % 9 + 1).cast("int"))
    hit = search.retrieval_plan(F.col("text"), F.lit(5))["intent"] == want
    return _asked(spark, sf).groupBy((F.col("id") % 9).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"))


# -- ranks -------------------------------------------------------------------------------------------


@query("r2_postings", r"select doc_id, (a + b)::bigint as hits, round((a + b) * 0.1 / (1 + (a + b) * 0.1), 6)::double as score from (select doc_id, len(list_filter(w, lambda x: starts_with(x, 'the'))) as a, len(list_filter(w, lambda x: starts_with(x, 'of'))) as b from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents)) where a > 0 and b > 0")
def posting_match(spark, sf):
    index = search.postings(table(spark, sf, "documents"), "doc_id", "text")
    return search.posting_match(index, "doc_id", "The of").select("doc_id", "hits", F.round("score", 6).alias("score"))


@query("r3_cover_density", r"""with w as (select doc_id, unnest(x) as x, generate_subscripts(x, 1) as p from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as x from documents)),
t as (select doc_id, p, x, lag(x) over o as px, lag(p) over o as pp from w where x in ('that', 'for') window o as (partition by doc_id order by p)),
r as (select doc_id, sum(0.1 / (p - pp)) as rank from t where x <> px group by 1)
select doc_id, round(coalesce(rank, 0), 6)::double as rank, round(coalesce(rank, 0) / (1 + coalesce(rank, 0)), 6)::double as score from documents left join r using (doc_id)""")
def cover_density(spark, sf):
    found = text_index.ranks(index.documents_index(spark, sf), "that for", whole=True).select(F.col("doc").alias("doc_id"), "rank")
    rows = table(spark, sf, "documents").select("doc_id").join(found, "doc_id", "left").fillna(0.0, ["rank"])
    return rows.select("doc_id", F.round("rank", 6).alias("rank"), F.round(F.col("rank") / (1 + F.col("rank")), 6).alias("score"))


NAMED = r"""n as (select p_partkey as note_id, len(regexp_extract_all(lower(p_name || ' ' || p_type), '(^|[^\p{L}\p{N}_])red')) as a, len(regexp_extract_all(lower(p_name || ' ' || p_type), '(^|[^\p{L}\p{N}_])ring')) as b, lower(p_name) = 'red ring' as t, lower(p_brand) = 'red ring' or p_type = 'ECONOMY' and p_name = 'red ring' as l from part),
rated as (select note_id, case when a > 0 and b > 0 then (a + b) * 0.1 / (1 + (a + b) * 0.1) end as lex, t::int as t, l::int as l from n)"""


@query("r4_note_rank", f"with {NAMED} select note_id, round(coalesce(lex, 0) + t + l, 6)::double as score from rated where lex is not null or t + l > 0 order by coalesce(lex, 0) + t + l desc, note_id limit 30")
def note_rank(spark, sf):
    alias = F.when(F.col("p_type") == "ECONOMY", F.upper("p_name"))
    notes = table(spark, sf, "part").select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("title"), F.array(F.col("p_brand"), alias).alias("aliases"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_size").alias("modified_at"))
    return search.note_search(notes, " Red  RING", 30).select("note_id", F.round("score", 6).alias("score"))


@query("r4_filtered_notes", r"""select note_id, round(a * 0.1 / (1 + a * 0.1), 6)::double as score from (select p_partkey as note_id, len(regexp_extract_all(lower(p_name || ' ' || p_type), '(^|[^\p{L}\p{N}_])r')) as a from part
  where p_type in ('ECONOMY', 'SMALL') and p_size > 10 and not starts_with(p_brand, 'Brand#1') and p_size % 2 = 0) where a > 0 order by a desc, note_id limit 40""")
def filtered_notes(spark, sf):
    p = table(spark, sf, "part")
    status = F.when(F.col("p_size") <= 10, "Draft").when(F.col("p_size") <= 30, " ").otherwise("ACTIVE")
    notes = p.select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("aliases"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_size").alias("modified_at"),
                     F.col("p_type").alias("note_type"), status.alias("status"), F.col("p_brand").alias("relative_path"), F.lit("x").alias("project"), F.array(F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    keep = filters.note_filter(types=["ECONOMY", "SMALL"], statuses=["Active "], not_prefixes=["Brand#1"], project="x", tags=["even"])
    return search.note_search(notes, "r", 40, keep=keep).select("note_id", F.round("score", 6).alias("score"))


@query("r5_recent_notes", "select p_partkey as note_id, 0.0::double as score from part order by p_size desc, p_partkey limit 10")
def recent_notes(spark, sf):
    notes = table(spark, sf, "part").select(F.col("p_partkey").alias("note_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("text"), F.col("p_size").alias("modified_at"))
    return search.note_search(notes, " ?! ", 10)


@query("r6_context_recall", r"select source as note_id, round(max(a * 0.1 / (1 + a * 0.1)), 6)::double as score from (select source, lang, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])the')) as a from documents where trim(text) <> '') where a > 0 and lang = 'en' group by 1 order by max(a) desc, 1 limit 8")
def context_recall(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("source").alias("note_id"), F.col("text").alias("content"), "lang")
    return search.context_recall(chunks, "the", 8, F.col("lang") == "en").select("note_id", F.round("score", 6).alias("score"))


@query("r14_fusion_trace", f"with {base.LANE} select (select count(*) from lex) as lexical_rows, (select count(distinct doc_id) from lex) as lexical_unique, (select count(*) from vec) as vector_rows, (select count(distinct doc_id) from vec) as vector_unique, (select count(*) from lex join vec using (doc_id)) as cross_lane, (select count(*) from (select doc_id from lex union select doc_id from vec)) as fused, (select count(*) - count(distinct doc_id) from lex) as lexical_repeated, (select count(*) - count(distinct doc_id) from vec) as vector_repeated, (select least(count(*), 20) from (select doc_id from lex union select doc_id from vec)) as returned")
def fusion_trace(spark, sf):
    lexical, vector = base._lanes(spark, sf)
    out = search.fusion_trace(lexical, vector, "doc_id", 20)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("r18_search", rf"""with {base.LANE}, lanes as (select doc_id, 'lexical' as lane, rank, 1.0::double / (60 + rank) as score from lex union all select doc_id, 'vector', rank, 1.01::double / (60 + rank) from vec),
best as (select * from lanes qualify row_number() over (partition by doc_id order by score desc, lane) = 1), top as (select *, row_number() over (order by score desc, lane, rank) as place from best qualify place <= 10)
select d.doc_id, place, lane, source, lang from documents d join top using (doc_id) order by place""")
def full_search(spark, sf):
    lexical, vector = base._lanes(spark, sf)
    ranked = retrieval.fuse(lexical, vector, "doc_id", 10)
    lanes = lexical.select("doc_id", F.col("rank").alias("lr")).join(vector.select("doc_id", F.col("rank").alias("vr")), "doc_id", "full_outer")
    order = [F.desc("score"), F.asc("lane"), F.when(F.col("lane") == "lexical", F.col("lr")).otherwise(F.col("vr")).asc()]
    ranked = ranked.join(lanes, "doc_id").withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return table(spark, sf, "documents").join(F.broadcast(ranked.select("doc_id", "place", "lane")), "doc_id").select("doc_id", "place", "lane", "source", "lang")


# -- cascades and briefs -------------------------------------------------------------------------------

STAGE = r"""hit as (select doc_id as context, source, lang, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])the')) as n from documents),
rated as (select *, least(n, 400) / 1000.0 as confidence, n * 0.1 / (1 + n * 0.1) as score from hit where n > 0)"""


def _stage(spark: SparkSession, sf: str, affinity: str, **wanted) -> DataFrame:
    rows = retrieval.lexical_match(filters.all_of(table(spark, sf, "documents"), **wanted), "text", "the")
    return rows.select(F.col("doc_id").alias("context"), F.lit(affinity).alias("affinity"), (F.least("hits", F.lit(400)) / 1000.0).alias("confidence"), "score")


@query("r21_recall_cascade", f"with {STAGE}, m as (select context, 1 as a, confidence, score from rated where source = 'src1' union all select context, 2, confidence, score from rated where source = 'src2' union all select context, 3, confidence, score from rated) select context, ['PRIMARY', 'RELATED', 'GLOBAL'][a] as affinity, round(confidence, 6)::double as confidence from (select * from m qualify row_number() over (partition by context order by a, confidence desc, score desc) = 1) order by a, confidence desc, score desc, context limit 25")
def recall_cascade(spark, sf):
    stages = [("primary", lambda: _stage(spark, sf, "PRIMARY", source="src1")), ("related", lambda: _stage(spark, sf, "RELATED", source="src2")), ("global", lambda: _stage(spark, sf, "GLOBAL"))]
    return search.cascade(stages, 25)[0].select("context", "affinity", F.round("confidence", 6).alias("confidence"))


@query("r23_cross_stage_dedup", "select o_custkey as context, affinity from (select o_custkey, ['PRIMARY', 'RELATED', 'GLOBAL'][case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end] as affinity, o_orderstatus, o_totalprice, o_orderkey from orders qualify row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end, o_totalprice desc, o_orderkey desc) = 1) order by case affinity when 'PRIMARY' then 1 when 'RELATED' then 2 else 3 end, o_totalprice desc, o_orderkey desc, o_custkey limit 50")
def cross_stage_dedup(spark, sf):
    affinity = F.when(F.col("o_orderstatus") == "F", "PRIMARY").when(F.col("o_orderstatus") == "O", "RELATED").otherwise("GLOBAL")
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("context"), affinity.alias("affinity"), F.col("o_totalprice").alias("confidence"), F.col("o_orderkey").alias("score"))
    return search.deduplicated(m, 50).select("context", "affinity")


@query("r24_outcome", f"with {STAGE} select case when max(confidence) >= 0.5 then 'MATCHED' when count(*) > 0 then 'NO_CONFIDENT_MATCH' else 'SEARCH_EXHAUSTED' end as outcome, coalesce(max(confidence), 0)::double as confidence, count(*) as matches from rated where source = 'src1'")
def recall_outcome(spark, sf):
    return search.outcome(_stage(spark, sf, "PRIMARY", source="src1"), degraded=False)


@query("r25_scopes", """with r as (select event_id, event_id % 3 = 0 as strict, case event_id % 4 when 0 then []::varchar[] when 1 then ['PROJECT', 'GLOBAL'] when 2 then ['USER', 'SESSION'] else ['GLOBAL'] end as requested,
  list_filter(['PROJECT', 'AGENT', 'SESSION', 'USER'], lambda x, i: (user_id >> (i - 1)) % 2 = 1) as have from events),
a as (select *, case when len(requested) > 0 then requested when strict then ['GLOBAL'] else ['PROJECT', 'AGENT', 'SESSION', 'USER', 'GLOBAL'] end as asked from r),
m as (select *, list_filter(asked, lambda x: x <> 'GLOBAL' and not list_contains(have, x)) as missing, list_filter(asked, lambda x: x = 'GLOBAL' or list_contains(have, x)) as rest from a)
select event_id, case when strict and len(missing) > 0 then 'error' when len(rest) > 0 then array_to_string(rest, ',') else 'GLOBAL' end as searched, array_to_string(list_transform(missing, lambda x: x || ':identity_unavailable'), ',') as skipped from m""")
def scopes(spark, sf):
    k = F.col("event_id") % 4
    lits = lambda *names: F.array(*map(F.lit, names))
    requested = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, lits("PROJECT", "GLOBAL")).when(k == 2, lits("USER", "USER", "SESSION")).otherwise(lits("GLOBAL"))
    have = F.filter(lits("PROJECT", "AGENT", "SESSION", "USER"), lambda x, i: F.call_function("shiftright", F.col("user_id"), i) % 2 == 1)
    found = table(spark, sf, "events").select("event_id", search.scopes(requested, have, F.col("event_id") % 3 == 0).alias("s"))
    return found.select("event_id", F.coalesce(F.array_join("s.searched", ","), F.lit("error")).alias("searched"), F.array_join("s.skipped", ",").alias("skipped"))


@query("r26_historical_cascade", "with s as (select l_orderkey, max(l_shipdate) as e from lineitem group by 1) select o_orderkey as context, 'PRIMARY' as affinity from orders left join s on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' and o_orderdate <= timestamp '1997-06-30' and (e is null or e >= timestamp '1997-06-30') order by o_totalprice desc, o_orderkey limit 40")
def historical_cascade(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    o = table(spark, sf, "orders").join(shipped, "o_orderkey", "left")

    def lane(affinity: str, **wanted):
        valid = filters.valid_at(filters.all_of(o, **wanted), F.lit("1997-06-30").cast("timestamp"), "o_orderdate", "e")
        return valid.select(F.col("o_orderkey").alias("context"), F.lit(affinity).alias("affinity"), F.lit(0.9).alias("confidence"), F.col("o_totalprice").alias("score"))

    return search.cascade([("primary", lambda: lane("PRIMARY", o_orderpriority="1-URGENT")), ("global", lambda: lane("GLOBAL"))], 40)[0].select("context", "affinity")


@query("r28_exact_selector", "select 'id' as kind, p_partkey as note_id from part where p_partkey = 7 union all select 'path', p_partkey from part where p_partkey = 9 union all select 'identity', min(p_partkey) from part where lower(p_brand) = 'brand#17' and p_type = 'SMALL' and p_size = 12 having count(*) = 1")
def exact_selector(spark, sf):
    notes = table(spark, sf, "part").select(F.col("p_partkey").alias("note_id"), F.concat(F.lit("n/"), "p_partkey", F.lit(".md")).alias("relative_path"), F.col("p_brand").alias("project"), F.col("p_type").alias("report"), F.col("p_size").cast("string").alias("edition"))
    pick = lambda kind, **by: search.exact_selector(notes, **by).select(F.lit(kind).alias("kind"), "note_id")
    return pick("id", note_id=7).union(pick("path", path="./n/9")).union(pick("identity", identity={"project": "BRAND#17 ", "report": "small", "edition": "12"}))


@query("r30_context_brief", """with m as (select lang as query, doc_id as context, n_chars % 997 as score, text, doc_id % 4 as had from documents where lang is not null),
top as (select *, row_number() over (partition by query order by score desc, context) as n from m qualify n <= 10), s as (select *, sum(case when had <> 0 then 1 else 0 end) over (partition by query order by n) as sent from top)
select query, context, case when had = 0 then 'already_delivered' when sent > 4 then 'omitted_record_budget' when had = 1 then 'changed' else 'new' end as state, n::int as position from s""")
def context_brief(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null")
    m = d.select(F.col("lang").alias("query"), F.col("doc_id").alias("context"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"), (F.col("n_chars") % 997).alias("score"), F.col("doc_id").alias("position"))
    had = m.where("context % 4 in (0, 1)").select("query", "context", F.when(F.col("context") % 4 == 0, F.col("content_hash")).otherwise(F.lit("old")).alias("content_hash"))
    return briefs.brief(m, had, byte_budget=10_000_000, record_budget=4).select("query", "context", "state", "position")


@query("r31_reindex_selection", "select vec_id from embeddings order by case when label <> 3 then 0 else 1 end, case when vec_id % 4 > 0 then label end nulls first, vec_id limit 480")
def reindex_selection(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("at", F.when(F.col("vec_id") % 4 > 0, F.col("label")))
    return search.reindex_selection(e, F.col("label") != 3, "at", "vec_id", 480, force=True).select("vec_id")


@query("r32_soft_rebuild", """with e as (select vec_id, label % 2 = 0 as fresh, case when vec_id % 4 > 0 then label end as since from embeddings), picked as (select vec_id from e where not fresh order by since nulls first, vec_id limit 100),
moments as (select 'before' as moment, fresh from e union all select 'after', fresh or vec_id in (select vec_id from picked) from e)
select moment, count(*) as total, count(*) filter (fresh) as current, count(*) - count(*) filter (fresh) as stale from moments group by 1""")
def soft_rebuild(spark, sf):
    """How many embeddings are current before and after a rebuild of at most 100 stale ones, which leaves the others as they are."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2 == 0).alias("current"), F.when(F.col("vec_id") % 4 > 0, F.col("label")).alias("since"))
    picked = search.reindex_selection(e, ~F.col("current"), "since", "vec_id", 100).select("vec_id", F.lit(True).alias("new"))
    rebuilt = e.join(F.broadcast(picked), "vec_id", "left").select((F.col("current") | F.coalesce("new", F.lit(False))).alias("current"))
    status = lambda df, moment: df.agg(F.count(F.lit(1)).alias("total"), F.count_if("current").alias("current")).select(F.lit(moment).alias("moment"), "total", "current", (F.col("total") - F.col("current")).alias("stale"))
    return status(e, "before").union(status(rebuilt, "after"))


@query("q11_ranking_stability", "select event_type, 1::bigint as rankings, sum(place * (event_id % 1000003))::bigint as ranking from (select *, row_number() over (partition by event_type order by value desc, event_id) as place from events) group by 1")
def ranking_stability(spark, sf):
    """Two runs over differently dealt rows: as many different rankings, and a sum that tells what the ranking is."""
    e = table(spark, sf, "events").select("event_type", "event_id", (-F.col("value")).alias("down"), F.lit(1).cast("long").alias("one"))

    def run(rows):
        at, h = with_running_sum(rows, ["event_type", "down", "event_id"], "one", "at"), F.col("event_id") % 1000003
        sums = at.groupBy("event_type").agg(F.sum(F.col("at") * h).alias("a"), F.sum(h).alias("h"), F.min("at").alias("first"))
        return sums.select("event_type", (F.col("a") - (F.col("first") - 1) * F.col("h")).alias("ranking"))

    runs = run(e).union(run(e.repartition(7)))
    return runs.groupBy("event_type").agg(F.countDistinct("ranking").alias("rankings"), F.min("ranking").alias("ranking"))
