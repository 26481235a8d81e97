"""Queries of upkeep: relations between memories and what follows, lint, packs, limits, cycles, moves, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import filters, graph, lint, packs, reconcile, rows
from mnemospark.plans.registry import query
from mnemospark.session import table
from mnemospark.streaming import limits

# -- relations: the lines of an order as claims, each against the lines before it -----------------------

DECIDED = """line as (select *, case when l_tax > 0.04 then ['taxed'] else [] end || case when l_discount > 0.05 then ['cut'] else [] end as q, l_linenumber % 3 = 0 as pol, l_suppkey % 2 as obj from lineitem),
pair as (select a.l_orderkey as o, a.l_linenumber as candidate, b.l_linenumber as existing, a.l_partkey = b.l_partkey as same_hash, a.l_suppkey = b.l_suppkey as same_source, 1 - abs(a.l_quantity - b.l_quantity) / 50 as ratio,
  (a.l_quantity >= 10) = (b.l_quantity >= 10) as fits, abs(date_diff('day', b.l_shipdate::date, a.l_shipdate::date)) <= 30 as meets, a.l_shipdate > b.l_shipdate as newer, a.l_quantity = 20 or b.l_quantity = 20 as bare,
  a.l_returnflag = b.l_returnflag as s, a.l_linestatus = b.l_linestatus as p, a.obj = b.obj as ob, a.pol = b.pol as pol, len(a.q) as na, len(b.q) as nb, len(list_intersect(a.q, b.q)) as common
  from line a join line b on a.l_orderkey = b.l_orderkey and a.l_linenumber > b.l_linenumber),
said as (select *, (s::int + p::int + ob::int) / 3 * 0.8 + case when na + nb = 0 then 1 else common / (na + nb - common) end * 0.2 as overlap from pair),
ruled as (select *, case when same_hash then 'DUPLICATE 1' when same_source and ratio >= 0.98 then 'DUPLICATE 0.99' when not fits then 'UNRELATED 0.98' when bare and ratio < 0.35 then 'UNRELATED 0.75' when bare then 'UNKNOWN 0.4'
  when s and p and ob and pol and common = na + nb - common then case when same_source then 'DUPLICATE 0.98' else 'SUPPORTS 0.98' end
  when s and p and not (ob and pol) and meets then 'CONTRADICTS 0.96' when s and p and newer and not meets then 'SUPERSEDES 0.95' when s and p and ob and pol and common = nb and na > nb then 'EXTENDS 0.9'
  when overlap >= 0.75 and ratio >= 0.7 then 'EXTENDS 0.78' when overlap < 0.25 and ratio < 0.35 then 'UNRELATED 0.9' else 'UNKNOWN 0.45' end as verdict from said),
decided as (select o, candidate, existing, split_part(verdict, ' ', 1) as relation, split_part(verdict, ' ', 2)::double as confidence, overlap from ruled),
chosen as (select * from decided qualify row_number() over (partition by o, candidate order by case relation when 'DUPLICATE' then 70 when 'CONTRADICTS' then 60 when 'SUPERSEDES' then 50 when 'SUPPORTS' then 40 when 'EXTENDS' then 30 when 'UNKNOWN' then 20 else 10 end desc, confidence desc, existing) = 1)"""


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("l_tax") > 0.04, "taxed"), F.when(F.col("l_discount") > 0.05, "cut")))
    claim = F.struct(F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("predicate"), (F.col("l_suppkey") % 2).cast("string").alias("object"), (F.col("l_linenumber") % 3 == 0).alias("polarity"), marks.alias("qualifiers"))
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", claim.alias("claim"))
    a, b = line.alias("a"), line.alias("b")
    pairs = a.join(b, (F.col("a.o") == F.col("b.o")) & (F.col("a.n") > F.col("b.n")))
    bare = (F.col("a.l_quantity") == 20) | (F.col("b.l_quantity") == 20)
    evidence = F.when(~bare, reconcile.claim_evidence(F.col("a.claim"), F.col("b.claim")))
    verdict = reconcile.classify(
        F.col("evidence"), F.col("ratio"), same_hash=F.col("a.l_partkey") == F.col("b.l_partkey"), same_source=F.col("a.l_suppkey") == F.col("b.l_suppkey"),
        compatible=(F.col("a.l_quantity") >= 10) == (F.col("b.l_quantity") >= 10), independent=F.col("a.l_suppkey") != F.col("b.l_suppkey"),
        overlapping=F.abs(F.datediff(F.col("a.l_shipdate"), F.col("b.l_shipdate"))) <= 30, newer=F.col("a.l_shipdate") > F.col("b.l_shipdate"),
    )
    rated = pairs.withColumn("evidence", evidence).withColumn("ratio", 1 - F.abs(F.col("a.l_quantity") - F.col("b.l_quantity")) / 50)
    return rated.select(F.col("a.o").alias("o"), F.col("a.n").alias("candidate"), F.col("b.n").alias("existing"), verdict.alias("v")).select("o", "candidate", "existing", "v.relation", "v.confidence")


@query("l6_claim_overlap", f"with {DECIDED} select o, candidate, existing, round(overlap, 6)::double as overlap from said")
def claim_overlap(spark, sf):
    marks = F.array_compact(F.array(F.when(F.col("l_tax") > 0.04, "taxed"), F.when(F.col("l_discount") > 0.05, "cut")))
    claim = F.struct(F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("predicate"), (F.col("l_suppkey") % 2).cast("string").alias("object"), (F.col("l_linenumber") % 3 == 0).alias("polarity"), marks.alias("qualifiers"))
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), claim.alias("claim"))
    a, b = line.alias("a"), line.alias("b")
    pairs = a.join(b, (F.col("a.o") == F.col("b.o")) & (F.col("a.n") > F.col("b.n")))
    overlap = F.round(reconcile.claim_evidence(F.col("a.claim"), F.col("b.claim"))["overlap"], 6)
    return pairs.select(F.col("a.o").alias("o"), F.col("a.n").alias("candidate"), F.col("b.n").alias("existing"), overlap.alias("overlap"))


@query("l7_relation_classifier", f"with {DECIDED} select o, candidate, existing, relation, confidence from decided")
def relation_classifier(spark, sf):
    return _decisions(spark, sf)


@query("l9_primary_decision", f"with {DECIDED} select o, candidate, existing, relation, confidence from chosen")
def primary_decision(spark, sf):
    return reconcile.primary_decisions(_decisions(spark, sf), ["o", "candidate"], [F.asc("existing")])


@query("l10_actions", f"""with {DECIDED} select o, candidate, existing, relation, unnest(range(len(a)))::int as step, unnest(a) as action from (select *, case relation when 'DUPLICATE' then ['MERGE_EVIDENCE', 'NOOP']
  when 'CONTRADICTS' then ['CREATE_CONTEXT', 'CREATE_RELATION', 'CREATE_CONFLICT_SET', 'QUEUE_REVIEW'] when 'SUPERSEDES' then ['CREATE_CONTEXT', 'CREATE_RELATION', 'MARK_SUPERSEDED', 'QUEUE_REVIEW'] when 'SUPPORTS' then ['MERGE_EVIDENCE', 'CREATE_RELATION']
  when 'EXTENDS' then ['CREATE_CONTEXT', 'CREATE_RELATION'] when 'UNKNOWN' then ['CREATE_CONTEXT', 'PRESERVE_CANDIDATE', 'QUEUE_REVIEW'] else ['CREATE_CONTEXT'] end as a from chosen)""")
def actions(spark, sf):
    return reconcile.actions(primary_decision(spark, sf)).select("o", "candidate", "existing", "relation", "step", "action")


@query("l14_cycle_buckets", f"with {DECIDED} select relation, count(*) as n, count(distinct o) as orders, round(min(confidence), 6)::double as least from chosen group by 1")
def cycle_buckets(spark, sf):
    return primary_decision(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("orders"), F.round(F.min("confidence"), 6).alias("least"))


# -- lint and redaction ----------------------------------------------------------------------------------


def _redacted_sql(source: str, text: str) -> str:
    steps = [f"r0 as (select *, coalesce({text}, '') as t, coalesce({text}, '') as u from {source})"]
    for i, pattern in enumerate(lint.SECRETS.values()):
        p = pattern.replace("'", "''")
        steps.append(f"r{i + 1} as (select * exclude (t), len(regexp_extract_all(t, '{p}')) as n{i}, regexp_replace(t, '{p}', '{lint.MASK}', 'g') as t from r{i})")
    n = len(lint.SECRETS)
    total, kinds = " + ".join(f"n{i}" for i in range(n)), " + ".join(f"(n{i} > 0)::int" for i in range(n))
    return ",\n".join(steps) + f",\nred as (select *, ({total})::int as n_redacted, {kinds} as kinds, regexp_matches(u, '{lint.PRIVATE_KEY}') as blocked from r{n})"


@query("q6_redaction", f"with {_redacted_sql('documents', 'text')} select doc_id, n_redacted, blocked, sha256(t) as redacted_hash from red")
def redaction(spark, sf):
    d = lint.redacted(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", "n_redacted", "blocked", F.sha2("redacted_text", 256).alias("redacted_hash"))


LINTED = """memo as (select doc_id, case doc_id % 4 when 0 then 'DECISION' when 1 then 'RESEARCH' when 2 then 'HANDOFF' else 'NOTE' end as kind, source as title,
  case when doc_id % 2 = 0 then '## Summary' || chr(10) || text || chr(10) || '##  Evidence ' else text end as content, case when doc_id % 3 > 0 then lang end as summary from documents)"""


@query("q5_lint", f"""with {LINTED}, {_redacted_sql('memo', 'content')},
w as (select *, (trim(coalesce(title, '')) = '')::int + (trim(u) = '')::int + blocked::int as n_errors, list_transform(regexp_extract_all(u, '(?m)^##\\s+([^\\n]+)', 1), lambda h: trim(h)) as heads,
  case kind when 'DECISION' then ['Summary', 'Key Decisions', 'Evidence'] when 'RESEARCH' then ['Summary', 'Evidence'] when 'HANDOFF' then ['Summary', 'Current State', 'Next Actions', 'Restore Prompt'] else [] end as need from red),
v as (select *, (trim(coalesce(summary, '')) = '')::int + len(list_filter(need, lambda x: not list_contains(heads, x))) + case when blocked then 0 else kinds end as n_warnings from w),
s as (select *, greatest(100 - 40 * n_errors - 8 * n_warnings, 0)::int as score from v)
select doc_id, n_errors::int as n_errors, n_warnings::int as n_warnings, score, case when blocked then 'BLOCKED_SECRET_RISK' when score < 70 then 'PENDING_REVIEW' when n_redacted > 0 then 'REDACTED_AND_SAVED' when n_warnings > 0 then 'SAVED_WITH_WARNINGS' else 'SAVED' end as status from s""")
def lint_documents(spark, sf):
    key = F.col("doc_id")
    kind = F.when(key % 4 == 0, "DECISION").when(key % 4 == 1, "RESEARCH").when(key % 4 == 2, "HANDOFF").otherwise("NOTE")
    content = F.when(key % 2 == 0, F.concat(F.lit("## Summary\n"), "text", F.lit("\n##  Evidence "))).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.col("source").alias("title"), content.alias("content"), F.when(key % 3 > 0, F.col("lang")).alias("summary"))
    return lint.lint(d, "kind", "title", "content", "summary").select("doc_id", "n_errors", "n_warnings", "score", "status")


# -- packs, limits, cycles, moves, time -------------------------------------------------------------------


@query("r29_context_pack", """with recursive m as (select lang as q, doc_id % 40 as context, doc_id as position, (n_chars % 997) / 997 as score, trim(coalesce(text, ''), ' ') as text, case doc_id % 3 when 0 then 'Project Context' when 1 then 'Agent Context' else 'Session Context' end as section from documents where lang is not null),
best as (select *, min(position) over (partition by q, context) as first from m qualify row_number() over (partition by q, context order by score desc, position) = 1),
ten as (select *, row_number() over (partition by q order by score desc, first, context) as n, least(count(*) over (partition by q), 10) as total from best qualify n <= 10),
walk as (select q, 0::bigint as n, 2000::bigint as rest, '' as content, 0::bigint as context, 0::double as score, '' as section from (select distinct q from ten)
  union all select q, n, rest - length(c), c, context, score, section from (select t.q, t.n, w.rest, t.context, t.score::double as score, t.section, case when length(t.text) <= w.rest // (t.total - t.n + 1) then t.text when w.rest // (t.total - t.n + 1) <= 0 then '' else t.text[1:(w.rest // (t.total - t.n + 1) - 1)] || '…' end as c
    from walk w join ten t on t.q = w.q and t.n = w.n + 1))
select q, n::int as position, context, round(score, 6) as score, section, sha256(content) as content_hash from walk where n > 0""")
def context_pack(spark, sf):
    key = F.col("doc_id")
    scope = F.when(key % 3 == 0, "PROJECT").when(key % 3 == 1, "USER").otherwise("SESSION")
    m = table(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("q"), (key % 40).alias("context"), key.alias("position"), (F.col("n_chars") % 997 / 997).alias("score"), scope.alias("scope"), "text")
    return packs.context_pack(m, "q", "context", budget=2000).select("q", "position", "context", F.round("score", 6).alias("score"), "section", F.sha2("content", 256).alias("content_hash"))


@query("r29_evidence_refs", """with m as (select lang as q, doc_id % 40 as context, doc_id as position, n_chars % 997 as score, list_concat([source, ' '], string_split(text, ' ')) as refs from documents where lang is not null and doc_id % 4 < 2 and doc_id % 5 <> 2),
best as (select *, min(position) over (partition by q, context) as first from m qualify row_number() over (partition by q, context order by score desc, position) = 1),
ten as (select *, row_number() over (partition by q order by score desc, first, context) as n from best qualify n <= 10),
r as (select q, n, unnest(refs) as ref, generate_subscripts(refs, 1) as i from ten), t as (select q, n, i, case when length(ref) > 300 then ref[1:299] || '…' else ref end as reference from r where regexp_matches(ref, '[^\\s\\p{Z}]')),
f as (select q, reference, min(n * 10000000 + i) as spot from t group by 1, 2)
select q, row_number() over (partition by q order by spot)::int as place, reference from f qualify place <= 20""")
def evidence_refs(spark, sf):
    """Of eligible documents, the words of the ten best of each language as what they refer to."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").where("lang is not null")
    ok = packs.eligible(F.when(k % 4 < 2, "SAVED").otherwise("PENDING_REVIEW"), k % 5 == 2, F.when(k % 2 == 0, "Active"))
    m = d.where(ok).select(F.col("lang").alias("q"), (k % 40).alias("context"), k.alias("position"), (F.col("n_chars") % 997).alias("score"), F.array("source", F.lit(" ")).alias("artifact_refs"), F.split("text", " ").alias("refs"))
    return packs.evidence_references(packs.selected(m, "q", "context"), "q", ["artifact_refs", "refs"])


@query("t3_rate_limit", """with recursive e as (select user_id, event_id, epoch_us(ts::timestamp) as t from events),
w as (select user_id, min(t) as s from e group by 1 union all select w.user_id, min(e.t) from w join e on e.user_id = w.user_id and e.t >= w.s + 86400000000 group by w.user_id, w.s),
held as (select e.*, w.s, row_number() over (partition by e.user_id, w.s order by t, event_id) as n from e asof join w on e.user_id = w.user_id and e.t >= w.s)
select user_id, event_id, n <= 3 as allowed, greatest(3 - n, 0)::bigint as remaining, greatest((s + 86400000000 - t + 500000) // 1000000, 1)::bigint as retry_after from held""")
def rate_limit(spark, sf):
    return limits.fixed_window(table(spark, sf, "events"), "user_id", "ts", "event_id", limit=3, seconds=86400)


FLOWS = """flow as (select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
  where c_nationkey % 5 = s_nationkey % 5 or c_nationkey < s_nationkey)"""


@query("g9_cycles", f"""with recursive {FLOWS}, r as (select src, dst from flow union select r.src, flow.dst from r join flow on r.dst = flow.src)
select a.src as id, least(min(b.src), a.src) as cycle from r a join r b on a.src = b.dst and a.dst = b.src group by a.src""")
def cycles(spark, sf):
    c, s = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    flow = j.where("c_nationkey % 5 = s_nationkey % 5 or c_nationkey < s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    return graph.cycles(flow)


@query("r27_temporal_view", """with shipped as (select l_orderkey, max(l_shipdate) as e from lineitem group by 1), m as (select o_orderkey, o_orderdate::timestamp as made, o_orderstatus = 'P' as archived, case when o_orderkey % 3 > 0 then o_orderdate::timestamp end as valid_from, case when o_orderkey % 3 = 1 then e::timestamp end as valid_to from orders left join shipped on l_orderkey = o_orderkey),
v as (select *, valid_from is not null or valid_to is not null as overlay, timestamp '1997-06-30' as t from m),
a as (select *, case when overlay then (valid_from is null or valid_from <= t) and (valid_to is null or t <= valid_to) else made <= t end as valid from v)
select o_orderkey, valid as historical, not archived and valid and (not overlay or valid_to is null) as current from a""")
def temporal_view(spark, sf):
    key = F.col("o_orderkey")
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("timestamp").alias("e"))
    made = F.col("o_orderdate").cast("timestamp")
    m = table(spark, sf, "orders").join(shipped, "o_orderkey", "left").select(
        "o_orderkey", made.alias("created_at"), (F.col("o_orderstatus") == "P").alias("is_archived"), F.when(key % 3 > 0, made).alias("valid_from"), F.when(key % 3 == 1, F.col("e")).alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"),
    )
    at = F.lit("1997-06-30").cast("timestamp")
    return m.select("o_orderkey", filters.recalled("HISTORICAL", at).alias("historical"), filters.recalled("CURRENT", at).alias("current"))


MOVES = """m as (select o_orderkey as n, 'p' || o_custkey || case when o_orderkey % 97 = 0 then '.txt' else '.md' end as source, case when o_orderkey % 89 = 0 then 'p' || o_custkey || '.md' else 'q' || (o_orderkey % 500) || '.md' end as destination, case when o_orderkey % 83 = 0 then ' ' else o_orderpriority end as reason from orders),
have as (select 'p' || c_custkey || '.md' as path, c_acctbal > 500 as is_file from customer where c_acctbal > 0 union select 'q' || s_suppkey || '.md', true from supplier where s_suppkey % 2 = 0),
k as (select m.*, case when trim(reason) = '' then 'reason_required' when source = destination then 'source_equals_destination' when source not like '%.md' or destination not like '%.md' then 'only_markdown_notes_can_be_moved'
  when f.path is null then 'source_missing' when not f.is_file then 'source_not_file' when t.path is not null then 'destination_exists' end as u from m left join have f on f.path = source left join have t on t.path = destination),
i as (select *, case when u is null then row_number() over (partition by source, u order by n) end as i from k), j as (select *, case when i = 1 then row_number() over (partition by destination, i order by n) end as j from i),
moved as (select n, coalesce(u, case when i > 1 then 'duplicate_source' when j > 1 then 'duplicate_destination' else 'ready' end) as state from j)"""


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    source = F.concat(F.lit("p"), "o_custkey", F.when(key % 97 == 0, ".txt").otherwise(".md"))
    to = F.when(key % 89 == 0, F.concat(F.lit("p"), "o_custkey", F.lit(".md"))).otherwise(F.concat(F.lit("q"), key % 500, F.lit(".md")))
    moves = table(spark, sf, "orders").select(key.alias("n"), source.alias("source"), to.alias("destination"), F.when(key % 83 == 0, " ").otherwise(F.col("o_orderpriority")).alias("reason"))
    customers = table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("p"), "c_custkey", F.lit(".md")).alias("path"), (F.col("c_acctbal") > 500).alias("is_file"))
    suppliers = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("q"), "s_suppkey", F.lit(".md")).alias("path"), F.lit(True).alias("is_file"))
    return rows.move_plan(moves, customers.union(suppliers), "n")


@query("c5_move_plan", f"with {MOVES} select n, state from moved")
def move_plan(spark, sf):
    return _moves(spark, sf).select("n", "state")


@query("c5_move_status", f"with {MOVES} select 'blocked' as status, count(*) as moves, count(*) filter (state = 'ready') as ready from moved")
def move_status(spark, sf):
    return rows.move_status(_moves(spark, sf))
