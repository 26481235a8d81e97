"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import calendar, filters, graph, linkage, retrieval, rows, text_index
from mnemospark.plans import expansion, index, notes_graph, records, upkeep  # noqa: F401  (they register their queries)
from mnemospark.plans.registry import QUERIES, SQL, query  # noqa: F401
from mnemospark.session import table
from mnemospark.streaming import change_log

WORDS = r"[\p{L}\p{N}_]+"


# -- retrieval ---------------------------------------------------------------------------------------

LANE = r"""
lex as (select doc_id, hits, row_number() over (order by hits desc, doc_id) as rank from (
  select doc_id, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])the')) as a, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])of')) as b, a + b as hits from documents)
  where a > 0 and b > 0 qualify rank <= 50),
probe as (select embedding as p from embeddings where vec_id = 0),
dist as (select vec_id as doc_id, 1 - list_sum(list_transform(list_zip(embedding, p), lambda x: x[1]::double * x[2]::double))
  / (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(p, lambda x: x::double * x::double)))) as d from embeddings, probe),
vec as (select doc_id, d, row_number() over (order by d, doc_id) as rank from dist qualify rank <= 50)
"""


def _probe(vectors: DataFrame) -> list[float]:
    """The vector that is searched for; none where it isn't in the table."""
    found = vectors.where("vec_id = 0").select("embedding").take(1)
    return list(found[0][0]) if found else []


def _lanes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings")
    found = text_index.counted(index.documents_index(spark, sf), "the of").withColumnRenamed("doc", "doc_id")
    lexical = retrieval.ranked(found, "doc_id", [F.desc("hits"), F.asc("doc_id")], 50)
    nearest = retrieval.vector_recall(vectors, "vec_id", "embedding", _probe(vectors), 50).withColumnRenamed("vec_id", "doc_id")
    return lexical, retrieval.ranked(nearest, "doc_id", [F.asc("distance"), F.asc("doc_id")], 50)


@query("r13_hybrid_fusion", f"""with {LANE}, lanes as (select doc_id, 'lexical' as lane, rank, 1.0::double / (60 + rank) as score from lex
  union all select doc_id, 'vector', rank, 1.01::double / (60 + rank) from vec),
best as (select *, row_number() over (partition by doc_id order by score desc, lane) as r from lanes)
select doc_id, round(score, 9) as score, lane from best where r = 1 order by best.score desc, lane, rank limit 20""")
def hybrid_fusion(spark, sf):
    lexical, vector = _lanes(spark, sf)
    return retrieval.fuse(lexical, vector, "doc_id", 20).select("doc_id", F.round("score", 9).alias("score"), "lane")


@query("r7_vector_recall", f"with {LANE} select doc_id as vec_id, round(1 - least(greatest(d, 0), 2) / 2, 6) as score from vec where rank <= 25")
def vector_recall(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return retrieval.vector_recall(vectors, "vec_id", "embedding", _probe(vectors), 25).select("vec_id", F.round("score", 6).alias("score"))


@query("r2_lexical_match", r"""select doc_id, (a + b)::int as hits, round((a + b) * 0.1 / (1 + (a + b) * 0.1), 6)::double as score from (
  select doc_id, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])the')) as a, len(regexp_extract_all(lower(text), '(^|[^\p{L}\p{N}_])of')) as b from documents) where a > 0 and b > 0""")
def lexical_match(spark, sf):
    found = text_index.counted(index.documents_index(spark, sf), "The of")
    return found.select(F.col("doc").alias("doc_id"), F.col("hits").cast("int").alias("hits"), F.round(text_index.score(F.col("hits") * text_index.WEIGHT), 6).alias("score"))


@query("r22_confidence", """select event_id, case when event_type = 'purchase' then 1.0::double else round(least(least(greatest(value / 100, 0), 1) + case when value > 50 then 0.1 else 0 end, 1), 6)::double end as confidence from events""")
def confidence(spark, sf):
    e = table(spark, sf, "events")
    second = F.when(F.col("value") > 50, F.lit(0.0))
    return e.select("event_id", F.round(retrieval.confidence([F.col("value") / 100, second], F.col("event_type") == "purchase"), 6).alias("confidence"))


@query("q10_retrieval_metrics", """with hits as (select o_custkey as case_id, o_orderkey as item, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 5),
expected as (select o_custkey as case_id, o_orderkey as item from orders where o_orderstatus = 'F'),
found as (select * from expected left join hits using (case_id, item))
select case_id, coalesce(bool_or(rank <= 1), false)::int::double as recall_1, coalesce(bool_or(rank <= 3), false)::int::double as recall_3, coalesce(bool_or(rank <= 5), false)::int::double as recall_5,
  round(coalesce(max(1.0 / rank), 0), 6)::double as rr, round(coalesce(sum(case when rank <= 5 then 1 / log2(rank + 1) else 0 end), 0) / list_sum(list_transform(range(1, least(count(*), 5)::bigint + 1), lambda i: 1 / log2(i + 1))), 6)::double as ndcg_5
from found group by case_id""")
def retrieval_metrics(spark, sf):
    from pyspark.sql.window import Window

    o = table(spark, sf, "orders")
    top = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item"), top.alias("rank")).where("rank <= 5")
    expected = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item"))
    return retrieval.retrieval_metrics(hits, expected, "case_id", "item")


CLASSES = ["TEMPORAL_CURRENT_STATE", "SUPERSESSION", "EXPERIENTIAL_RECALL", "PROCEDURAL_RECALL", "WRONG_PREMISE", "CONFLICT_PRESERVATION", "MULTI_HOP_GRAPH", "CROSS_LANGUAGE", "EXACT_TITLE", "SEMANTIC"]
CASES = f"""cases as (select c_custkey as "case", {CLASSES}[c_nationkey % 10 + 1] as query_class, c_acctbal < 0 as abstains from customer),
ranked as (select o_custkey as "case", o_orderpriority, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, o_orderstatus from orders),
t as (select o_custkey as "case", count(*) filter (o_orderstatus = 'F') as e, count(*) filter (o_orderstatus = 'P') as f from orders group by 1),
h as (select "case", count(*) as n, min(rank) filter (o_orderstatus = 'F') as r, count(*) filter (o_orderstatus = 'F' and rank <= 5) as g, count(*) filter (o_orderstatus = 'P' and rank <= 5) as b,
  coalesce(sum(1 / log2(rank + 1)) filter (o_orderstatus = 'F' and rank <= 5), 0) as gain, bool_or(o_orderpriority = '1-URGENT') as urgent from ranked where rank <= 8 group by 1),
x as (select cases.*, coalesce(e, 0) as e, coalesce(f, 0) as f, coalesce(n, 0) as n, r, coalesce(g, 0) as g, coalesce(b, 0) as b, coalesce(gain, 0) as gain, coalesce(urgent, false) as urgent from cases left join t using ("case") left join h using ("case")),
y as (select *, coalesce(r <= 1, false)::int::double as r1, coalesce(r <= 3, false)::int::double as r3, coalesce(r <= 5, false)::int::double as r5 from x),
m as (select "case", query_class, case when not abstains then r1 end as recall_1, case when not abstains then r3 end as recall_3, case when not abstains then r5 end as recall_5, case when not abstains then round(coalesce(1.0 / r, 0), 6)::double end as rr,
  case when not abstains and e > 0 then round(gain / list_sum(list_transform(range(1, least(e, 5)::bigint + 1), lambda i: 1 / log2(i + 1))), 6)::double end as ndcg_5,
  case when f > 0 then round(b / greatest(1, least(n, 5)), 6)::double end as obsolete_rate,
  case when query_class = 'TEMPORAL_CURRENT_STATE' then (coalesce(r = 1, false) and b = 0)::int::double end as temporal_correctness, case when query_class = 'SUPERSESSION' then (b > 0)::int::double end as superseded_leakage,
  case when query_class in ('TEMPORAL_CURRENT_STATE', 'SUPERSESSION') then round(g / greatest(1, g + b), 6)::double end as current_precision,
  case when query_class = 'EXPERIENTIAL_RECALL' then r3 end as experiential_recall, case when query_class = 'PROCEDURAL_RECALL' then r3 end as procedural_recall, case when query_class = 'CROSS_LANGUAGE' then r3 end as cross_language,
  case when query_class = 'WRONG_PREMISE' then (r3 = 1 and b = 0)::int::double end as wrong_premise, case when query_class = 'CONFLICT_PRESERVATION' then (g < 2)::int::double end as conflict_collapse,
  case when abstains then (n > 0)::int::double else (r is null or b > 0)::int::double end as wrong_memory, case when abstains then (n = 0)::int::double end as abstention,
  case when query_class = 'MULTI_HOP_GRAPH' then (g >= 2 and urgent and n >= 3)::int::double end as multi_hop from y)"""


def _case_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cases: their eight dearest orders are the hits, finished orders are expected, pending ones forbidden."""
    from pyspark.sql.window import Window

    kind = F.get(F.array(*map(F.lit, CLASSES)), F.col("c_nationkey") % 10)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("item"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    top = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("o_totalprice"), "item"))
    hits = o.withColumn("rank", top).where("rank <= 8")
    walks = hits.groupBy("case").agg(F.collect_set("o_orderpriority").alias("seen"), F.count(F.lit(1)).alias("seen_distance"))  # eight rows a case at most
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case"), kind.alias("query_class"), (F.col("c_acctbal") < 0).alias("abstains"), F.lit(2).alias("least"), F.array(F.lit("1-URGENT")).alias("required"), F.lit(3).alias("least_distance"))
    cases = cases.join(walks, "case", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).fillna(0, ["seen_distance"])
    truth = o.where("o_orderstatus in ('F', 'P')").select("case", "item", (F.col("o_orderstatus") == "F").alias("expected"))
    return retrieval.case_metrics(cases, truth, hits.select("case", "item", "rank"))


@query("q10_case_metrics", f"with {CASES} select * from m")
def case_metrics(spark, sf):
    return _case_metrics(spark, sf)


MEANS = ["recall_1", "recall_3", "recall_5", "rr", "ndcg_5", "obsolete_rate", "temporal_correctness", "superseded_leakage", "current_precision", "experiential_recall", "procedural_recall", "cross_language", "wrong_premise", "conflict_collapse", "wrong_memory", "abstention", "multi_hop"]


@query("q10_mean_metrics", f"with {CASES} select query_class, count(*) as cases, {', '.join(f'round(avg({c}), 6)::double as {c}' for c in MEANS)} from m group by 1")
def mean_metrics(spark, sf):
    return retrieval.mean_metrics(_case_metrics(spark, sf), "query_class")


# -- text ----------------------------------------------------------------------------------------------

@query("d8_token_count", rf"select doc_id, len(regexp_extract_all(text, '{WORDS}'))::int as tokens from documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("d12_embedding_text", """select l.doc_id, sha256('passage: Title: ' || source || chr(10) || 'Heading: ' || lang || chr(10) || chr(10) || text) as input_hash from documents l""")
def embedding_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(T.embedding_text(F.col("source"), F.col("lang"), F.col("text")), 256).alias("input_hash"))


@query("f12_excerpt", r"""with t as (select doc_id, trim(regexp_replace(text, '[\t\n\v\f\r ]+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) <= 240 then t else rtrim(t[1:237], ' ') || '...' end as excerpt from t""")
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("g6_trigrams", r"""with t as (select p_partkey, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '_', 'g'), '_') as t from part)
select p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2]))), ' ') as grams from t""")
def trigrams(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.trigrams(F.col("p_name")), " ").alias("grams"))


@query("d10_target_path", r"""select page_id, case when regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*://|^#|^artifact:|^evidence:|^/|(^|/)\.\.(/|$)') or p = '' then null when lower(p) like '%.md' then p else p || '.md' end as path
from (select page_id, case when page_id % 3 = 0 then url else regexp_replace(url, '^https?://', '') end as p from pages)""")
def target_path(spark, sf):
    p = table(spark, sf, "pages")
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return p.select("page_id", T.target_path(raw).alias("path"))


# -- filters, joins, aggregates ------------------------------------------------------------------------

@query("f1_list_filter", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice between 1000 and 200000")
def list_filter(spark, sf):
    return filters.all_of(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_totalprice=(1000, 200000), o_custkey=None).select("o_orderkey")


@query("f2_tag_containment", "select p_partkey from part where list_has_all(list_concat(string_split(p_name, ' '), [p_type]), ['red', 'SMALL'])")
def tag_containment(spark, sf):
    tags = F.concat(F.split("p_name", " "), F.array("p_type"))
    return table(spark, sf, "part").where(filters.has_tags(tags, ["red", "SMALL"])).select("p_partkey")


@query("f3_scope_predicate", "select doc_id from documents where source = 'src1' or lang = 'de'")
def scope_predicate(spark, sf):
    d = table(spark, sf, "documents").withColumn("scope", F.when(F.col("lang") == "de", "GLOBAL").otherwise("PROJECT"))
    return d.where(filters.in_scopes(F.col("scope"), {"PROJECT": (F.col("source"), "src1"), "GLOBAL": (F.col("source"), None)})).select("doc_id")


@query("f3_workspace", "select doc_id, 'named' as asked from documents where source = 'src1' and doc_id % 3 = 1 union all select doc_id, 'none' from documents where source = 'src1' and doc_id % 3 <> 1")
def workspace(spark, sf):
    """One project, asked for within a workspace and without one."""
    k = F.col("doc_id") % 3
    d = table(spark, sf, "documents").withColumn("workspace", F.when(k == 1, "w").when(k == 2, "")).where(filters.in_scopes(F.lit("PROJECT"), {"PROJECT": (F.col("source"), "src1")}))
    asked = [F.when(filters.in_workspace(F.col("workspace"), w), F.lit(name)) for w, name in (("w", "named"), (None, "none"))]
    return d.select("doc_id", F.explode(F.array_compact(F.array(*asked))).alias("asked"))


@query("f5_lifecycle", "select p_partkey from part where p_size <= 20 and not starts_with(p_brand, '_Ops/')")
def lifecycle(spark, sf):
    p = table(spark, sf, "part").withColumn("status", F.when(F.col("p_size") <= 10, " ").when(F.col("p_size") <= 20, "SAVED ").otherwise("archived"))
    return p.where(filters.visible(F.lit("indexed"), F.col("status"), F.col("p_brand"), ["CURRENT"])).select("p_partkey")


@query("f10_path_search", "select c_custkey from customer where contains(lower(c_name || chr(10) || c_mktsegment), 'build')")
def path_search(spark, sf):
    return filters.containing(table(spark, sf, "customer"), "BUILD", ["c_name", "c_mktsegment"]).select("c_custkey")


@query("a1_count_by_status", "select o_orderstatus as status, count(*) as n from orders group by 1")
def count_by_status(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a2_source_revision", "select count(*) || ':' || strftime(max(o_orderdate), '%Y-%m-%d') as revision from orders")
def source_revision(spark, sf):
    return table(spark, sf, "orders").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).alias("revision"))


@query("a4_embedding_status", "select count(*) as total, count(*) filter (label % 2 = 0) as current, greatest(count(*) - count(*) filter (label % 2 = 0), 0) as stale, count(distinct label) as fingerprints from embeddings")
def embedding_status(spark, sf):
    current = F.count_if(F.col("label") % 2 == 0)
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("total"), current.alias("current"), F.greatest(F.count(F.lit(1)) - current, F.lit(0)).alias("stale"), F.countDistinct("label").alias("fingerprints"))


@query("a6_exact_duplicates", "select sha256(text) as digest, min(doc_id) as first_member, count(*) as members from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, sf):
    return rows.duplicate_groups(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("a6_duplicate_members", "select digest, row_number() over (partition by digest order by doc_id) as place, doc_id from (select distinct sha256(text) as digest, doc_id from documents where text is not null and doc_id is not null) qualify count(*) over (partition by digest) > 1")
def duplicate_members(spark, sf):
    return rows.duplicate_members(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("a7_best_per_key", "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) = 1")
def best_per_key(spark, sf):
    return rows.best_per_key(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")])


@query("a14_percentiles", "select event_type, round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95, round(min(value), 6) as low, round(max(value), 6) as high from events group by 1")
def percentiles(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type")
    disc = lambda p: F.round(F.expr(f"percentile_disc({p}) within group (order by value)"), 6)
    return e.agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("a14_summary", "select event_type, count(value) as samples, round(quantile_disc(value, 0.5), 3) as p50, round(quantile_disc(value, 0.95), 3) as p95, round(avg(value), 3) as mean, round(min(value), 3) as low, round(max(value), 3) as high from events group by 1")
def summary(spark, sf):
    disc = lambda p: F.round(F.expr(f"percentile_disc({p}) within group (order by value)"), 3)
    of = lambda f: F.round(f("value"), 3)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("samples"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), of(F.avg).alias("mean"), of(F.min).alias("low"), of(F.max).alias("high"))


@query("a17_key_difference", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def key_difference(spark, sf):
    open_ = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(open_, "c_custkey", "left_anti")


@query("a19_keyset_page", "select o_orderkey, (select o_orderkey from orders where o_orderkey > 100 order by 1 offset 24 limit 1) as next_cursor from orders where o_orderkey > 100 order by o_orderkey limit 25")
def keyset_page(spark, sf):
    return filters.keyset_page(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 25)


@query("j8_interval_overlap", """with v as (select o_custkey, o_orderkey, o_orderdate as s, max(l_shipdate) as e from orders left join lineitem on l_orderkey = o_orderkey group by all)
select a.o_custkey, a.o_orderkey as left_id, b.o_orderkey as right_id from v a join v b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and (a.s <= b.e or b.e is null) and (b.s <= a.e or a.e is null)
where (a.e is null or a.s <= a.e) and (b.e is null or b.s <= b.e)""")
def interval_overlap(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    v = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s")).join(shipped, "o_orderkey", "left")
    return rows.overlapping_pairs(v.where("e is null or s <= e"), "o_custkey", "o_orderkey", "s", "e")


@query("j9_as_of", "select o_orderkey from (select o_orderkey, o_orderdate, max(l_shipdate) as e from orders left join lineitem on l_orderkey = o_orderkey group by all) where o_orderdate <= timestamp '1996-06-30' and (e is null or e >= timestamp '1996-06-30')")
def as_of(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    v = table(spark, sf, "orders").join(shipped, "o_orderkey", "left")
    return filters.valid_at(v, F.lit("1996-06-30").cast("timestamp"), "o_orderdate", "e").select("o_orderkey")


SNAPSHOTS = """now as (select o_orderkey as k, sha256(o_orderstatus || '|' || o_custkey) as h from orders where o_orderdate >= timestamp '1996-01-01'),
old as (select o_orderkey as k, sha256(case o_orderstatus when 'P' then 'O' else o_orderstatus end || '|' || o_custkey) as h from orders where o_orderdate < timestamp '2000-07-01')"""


@query("j11_snapshot_diff", f"""with {SNAPSHOTS} select k, case when old.h is null then 'added' when now.h is null then 'removed' else 'updated' end as change from now full join old using (k) where now.h is distinct from old.h""")
def snapshot_diff(spark, sf):
    o = table(spark, sf, "orders")  # the orders as of July 2000, with those pending still open, and today's without the years before 1996
    now = o.where("o_orderdate >= timestamp '1996-01-01'").select(F.col("o_orderkey").alias("k"), F.sha2(F.concat_ws("|", "o_orderstatus", "o_custkey"), 256).alias("h"))
    was = F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))
    then = o.where("o_orderdate < timestamp '2000-07-01'").select(F.col("o_orderkey").alias("k"), F.sha2(F.concat_ws("|", was, "o_custkey"), 256).alias("h"))
    return rows.snapshot_diff(now, then, "k", "h")


@query("q14_source_set_hash", "select o_custkey, count(*) as sources, sha256(string_agg(h, '|' order by h)) as source_set_hash from (select distinct o_custkey, sha256(o_orderkey || '|' || o_orderstatus) as h from orders) group by 1")
def source_set_hash(spark, sf):
    return rows.source_set_hash(table(spark, sf, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"])


# -- calendar, change log ------------------------------------------------------------------------------

@query("q1_coverage", """with p as (select event_type as family, ts::date as day, min((ts + interval 3 hour)::date) as made from events group by 1, 2),
span as (select min(day) as a from p), grid as (select family, (unnest(generate_series(a::timestamp, a + interval 60 day, interval 1 day)))::date as day from (select distinct family from p), span)
select family, day, case when day >= a + interval 45 day then 'OPEN' when made is null then 'MISSING' when made > day then 'BACKFILL' else 'COMPLETE' end as state from grid left join p using (family, day), span""")
def coverage(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("family"), F.to_date("ts").alias("day"), (F.col("ts") + F.expr("interval 3 hours")).alias("created"))
    from datetime import date, timedelta

    first = e.agg(F.min("day")).first()[0] or date.today()

    at = lambda n: str(first + timedelta(days=n))
    return calendar.coverage(e, at(0), at(60), at(45))


@query("q3_week_labels", "select o_orderkey, strftime(o_orderdate, '%G-W%V') as week, ((day(o_orderdate) - 1) // 7 + 1)::int as month_week from orders")
def week_labels(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", calendar.iso_week(F.col("o_orderdate")).alias("week"), calendar.month_week(F.col("o_orderdate")).alias("month_week"))


@query("t1_delta_read", "select event_id, event_type, (select count(*) from events where event_id > 500) > 64 as has_more from events where event_id > 500 order by event_id limit 64")
def delta_read(spark, sf):
    return change_log.delta(table(spark, sf, "events"), 500, sequence="event_id").select("event_id", "event_type", "has_more")


ENTRY = """'{"event_id":' || event_id || ',"event_type":"' || event_type || '"}'"""


@query("t1_delta_page", f"""with n as (select event_id, event_type, row_number() over (order by event_id) as r, sum(strlen({ENTRY})) over (order by event_id) as b, count(*) over () as total from events where event_id > 500),
page as (select * from n where r <= 64 and (r = 1 or b <= 2000))
select event_id, event_type, (select count(*) from page) < total as has_more, translate(to_base64(encode('{{"v":1,"scope":"context-change-log","last_sequence":' || (select max(event_id) from page) || '}}')), '+/', '-_') as next_cursor from page""")
def delta_page(spark, sf):
    log = table(spark, sf, "events").select("event_id", "event_type")
    return change_log.delta_page(log, change_log.cursor_token(500), sequence="event_id", most_bytes=2000)


@query("t7_windowed_counts", "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_counts(spark, sf):
    return change_log.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"], "value", "1 hour").withColumn("total", F.round("total", 4))


# -- graph, linkage ------------------------------------------------------------------------------------

EDGES = """edges as (select 'e' || l_orderkey || '-' || l_linenumber as edge_id, 'c' || o_custkey as src, 's' || l_suppkey as dst,
  case l_returnflag when 'A' then 'supersedes' when 'N' then 'related' else 'wikilink' end as relation, round(1 - l_discount, 2) as confidence from lineitem join orders on o_orderkey = l_orderkey)"""
NODES = "nodes as (select 'c' || c_custkey as id from customer union all select 's' || s_suppkey from supplier)"


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    relation = F.when(F.col("l_returnflag") == "A", "supersedes").when(F.col("l_returnflag") == "N", "related").otherwise("wikilink")
    edges = j.select(
        F.concat(F.lit("e"), "l_orderkey", F.lit("-"), "l_linenumber").alias("edge_id"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"),
        relation.alias("relation"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
    return nodes, edges


@query("a11_degrees", f"""with {EDGES}, {NODES}, e as (select distinct src, dst from edges)
select id, coalesce(o, 0)::bigint as out_degree, coalesce(i, 0)::bigint as in_degree from nodes left join (select src as id, count(*) as o from e group by 1) using (id) left join (select dst as id, count(*) as i from e group by 1) using (id)""")
def degrees(spark, sf):
    """Pairs of keys are made distinct before they have names."""
    nodes, _ = _graph(spark, sf)
    pairs = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    edges = pairs.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph.degrees(nodes, edges, distinct=True)


@query("g8_orphans", f"with {EDGES}, {NODES} select id from nodes where id not in (select src from edges union all select dst from edges)")
def orphans(spark, sf):
    return graph.orphans(*_graph(spark, sf))


@query("g11_related", f"""with {EDGES} select src as neighbour, relation, edge_id, round(case relation when 'supersedes' then 0.8 when 'related' then 0.6 else 0.5 end + confidence, 4)::double as score from edges
where dst = 's1' qualify row_number() over (partition by src order by round(case relation when 'supersedes' then 0.8 when 'related' then 0.6 else 0.5 end + confidence, 4) desc, edge_id) = 1""")
def related(spark, sf):
    _, edges = _graph(spark, sf)
    return graph.related(edges, "s1").withColumn("score", F.round("score", 4))


@query("g3_reach", f"""with {EDGES}, p as (select distinct src, dst from edges), e as (select src, dst from p union select dst, src from p), one as (select distinct dst as id from e where src = 's1'),
two as (select distinct dst as id from e where src in (from one) and dst <> 's1' and dst not in (from one)) select 's1' as id, 0 as depth union all select id, 1 from one union all select id, 2 from two""")
def reach(spark, sf):
    _, edges = _graph(spark, sf)
    return graph.reach(edges, "s1", 2, directed=False)


#: Vectors block on their label: any two of one are compared.
MET = "met as (select a.vec_id as left_id, b.vec_id as right_id from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)"
SCORED = """select left_id, right_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::double * x[2]::double))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double)))), 6) as score,
  a.label as left_label, b.label as right_label from met join embeddings a on a.vec_id = left_id join embeddings b on b.vec_id = right_id"""
PAIRS = f"{MET}, pairs as ({SCORED})"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", F.array(F.col("label").cast("string")).alias("blocks"))


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<bigint>")
    items = _labelled(spark, sf).withColumns({"content_hash": F.lit(None).cast("string"), "neighbours": none, "ancestors": none})
    return linkage.candidate_pairs(items, vector=0.3, max_block=None, digits=6)


@query("l1_candidates", f"with {PAIRS} select left_id, right_id, score from pairs where score >= 0.3")
def candidates(spark, sf):
    return _linked(spark, sf).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("l4_clusters", f"""with recursive {PAIRS}, e as (select left_id as a, right_id as b from pairs where score >= 0.3 union select right_id, left_id from pairs where score >= 0.3),
r as (select a as item_id, a as root from e union select e.b, r.root from r join e on e.a = r.item_id where r.root < e.b) select item_id, min(root) as cluster from r group by 1""")
def clusters(spark, sf):
    return linkage.near_clusters(_labelled(spark, sf), 0.3)
