"""Queries over the note graph: customers and suppliers as notes, the lines of orders as links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators import projection as P
from mnemospark.plans.registry import query
from mnemospark.session import table

NOTES = """note as (select 'c' || c_custkey as note_id, 'c/c' || c_custkey || '.md' as relative_path, c_mktsegment || ' ' || c_nationkey as title, c_nationkey::varchar as project, [c_mktsegment] as tags, case when c_acctbal < -500 then 'stale' when c_acctbal > 9500 then 'error' else 'indexed' end as index_status from customer
  union all select 's' || s_suppkey, 's/s' || s_suppkey || '.md', s_name, s_nationkey::varchar, [], 'indexed' from supplier)"""
LINKS = """link as materialized (select 'c' || o_custkey || '>s' || l_suppkey || ':' || case l_returnflag when 'A' then 'supersedes' when 'N' then 'contains' else 'wikilink' end as edge_id, 'c' || o_custkey as src, 's' || l_suppkey as dst, case l_returnflag when 'A' then 'supersedes' when 'N' then 'contains' else 'wikilink' end as relation from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3, 4)"""


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    status = F.when(F.col("c_acctbal") < -500, "stale").when(F.col("c_acctbal") > 9500, "error").otherwise("indexed")
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("note_id"), F.concat(F.lit("c/c"), "c_custkey", F.lit(".md")).alias("relative_path"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("title"),
        F.col("c_nationkey").cast("string").alias("project"), F.array("c_mktsegment").alias("tags"), none.alias("aliases"), status.alias("index_status"),
    )
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("note_id"), F.concat(F.lit("s/s"), "s_suppkey", F.lit(".md")).alias("relative_path"), F.col("s_name").alias("title"),
        F.col("s_nationkey").cast("string").alias("project"), none.alias("tags"), F.array(F.concat(F.lit("Sup "), "s_suppkey")).alias("aliases"), F.lit("indexed").alias("index_status"),
    )
    return c.unionByName(s)


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Each link once for a customer, a supplier and a relation: summed before anything is joined with it."""
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    relation = F.when(F.col("l_returnflag") == "A", "supersedes").when(F.col("l_returnflag") == "N", "contains").otherwise("wikilink")
    links = j.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), relation.alias("relation")).distinct()
    return links.withColumn("edge_id", F.concat("src", F.lit(">"), "dst", F.lit(":"), "relation")).withColumn("source_kind", F.lit("body"))


#: Links as written: some by id, some by path in any case, some by a name; some lead nowhere.
WRITTEN = f"""{NOTES}, {LINKS}, n as (select *, substr(dst, 2)::bigint as k from link),
written as (select edge_id, src as source_note_id, case when k % 5 = 0 then dst end as target_note_id, case k % 5 when 0 then 'gone' when 1 then 'S/S' || k || '.MD' when 2 then 'SUP ' || k when 3 then 'nowhere-' || k else 'c/' || src || '.md' end as target_path, k from n),
state as (select w.*, case when k % 5 in (0, 1, 2) then 's' || k when k % 5 = 4 and o.index_status = 'indexed' then source_note_id end as dst, case when k % 5 < 3 then 'RESOLVED' when k % 5 = 3 then 'MISSING' when o.index_status = 'indexed' then 'RESOLVED' else 'TARGET_NOT_INDEXED' end as state, o.index_status from written w join note o on o.note_id = source_note_id)"""


def _written(spark: SparkSession, sf: str) -> DataFrame:
    k = F.substring("dst", 2, 18).cast("long")
    target = F.when(k % 5 == 0, "gone").when(k % 5 == 1, F.concat(F.lit("S/S"), k, F.lit(".MD"))).when(k % 5 == 2, F.concat(F.lit("SUP "), k)).when(k % 5 == 3, F.concat(F.lit("nowhere-"), k)).otherwise(F.concat(F.lit("c/"), "src", F.lit(".md")))
    return _links(spark, sf).select("edge_id", F.col("src").alias("source_note_id"), F.when(k % 5 == 0, F.col("dst")).alias("target_note_id"), target.alias("target_path"), "relation", "source_kind")


@query("j6_target_resolution", f"with {WRITTEN} select edge_id, coalesce(dst, '-') as dst, state from state")
def target_resolution(spark, sf):
    return P.resolved(_written(spark, sf), _notes(spark, sf)).select("edge_id", F.coalesce("dst", F.lit("-")).alias("dst"), "state")


@query("j7_diagnostic_resolution", f"with {WRITTEN} select state, count(*) as n from state group by 1")
def diagnostic_resolution(spark, sf):
    return P.resolved(_written(spark, sf), _notes(spark, sf)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("g1_projection", f"""with {WRITTEN} select 'nodes' as name, count(*) as n from note where index_status = 'indexed' union all select 'edges', count(*) from state where state = 'RESOLVED' and index_status = 'indexed'
union all select state, count(*) from state where state <> 'RESOLVED' group by 1 union all select 'INDEX_ERROR', count(*) from note where index_status = 'error' having count(*) > 0""")
def projection(spark, sf):
    return P.projection_metrics(*P.projection(_notes(spark, sf), _written(spark, sf)))


@query("g2_batches", f"with {LINKS} select edge_id, (row_number() over (order by edge_id) - 1) // 1000 as batch from link")
def batches(spark, sf):
    return P.batches(_links(spark, sf).select("edge_id"), ["edge_id"], 1000)


WALK = f"""{LINKS}, step as materialized (select distinct src, dst from link where relation in ('supersedes', 'wikilink') union select distinct dst, src from link where relation in ('supersedes', 'wikilink')),
one as materialized (select dst as id, 1 as depth, 1 + row_number() over (order by dst) as place from step where src = 's1'),
far as materialized (select dst as id, min(place) as p from step join one on src = one.id where dst <> 's1' group by 1), two as materialized (select far.id, 2 as depth, (select count(*) + 1 from one) + row_number() over (order by p, far.id) as place from far anti join one on one.id = far.id),
walk as materialized (select * from (select 's1' as id, 0 as depth, 1 as place union all select * from one union all select * from two) where place <= 300),
beyond as materialized (select count(*) as n from (select distinct step.dst from step join walk on walk.id = step.src) d anti join walk on walk.id = d.dst)"""


def _walk(spark: SparkSession, sf: str, start: str = "s1", most: int = 300) -> DataFrame:
    return P.traverse(_notes(spark, sf), _links(spark, sf), start, direction="both", relations=("supersedes", "wikilink"), max_depth=2, max_results=most)


@query("g3_traverse", f"with {WALK} select id, depth::int as depth, place::int as place, beyond.n > 0 as truncated from walk, beyond")
def traverse(spark, sf):
    return _walk(spark, sf).select("id", "depth", "place", "truncated")


@query("g4_lineage", """with recursive o as (select o_orderkey as id, lag(o_orderkey, 1) over w as p, case when o_orderkey % 3 = 0 then lag(o_orderkey, 2) over w end as q from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
e as (select id as src, p as dst from o where p is not null union select id, q from o where q is not null), s as (select min(o_orderkey) as id from orders),
a as (select id, 0 as depth from s union select dst, depth + 1 from a join e on src = a.id where depth < 8), b as (select id, 0 as depth from s union select src, depth + 1 from b join e on dst = b.id where depth < 8)
select id, min(depth)::int as depth, 'supersedes' as way from a group by 1 having min(depth) > 0 union all select id, min(depth)::int, 'superseded_by' from b group by 1 having min(depth) > 0""")
def note_lineage(spark, sf):
    """Orders as notes: each supersedes its customer's order before, every third one the order before that too, and links to the third before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("note_id"), "o_orderkey")
    before = lambda i, way: F.struct(F.lag("o_orderkey", i).over(w).alias("dst"), F.lit(way).alias("relation"))
    ways = F.array(before(1, "supersedes"), F.when(F.col("o_orderkey") % 3 == 0, before(2, "supersedes")), before(3, "wikilink"))
    edges = orders.select(F.col("o_orderkey").alias("src"), ways.alias("ways")).select("src", F.explode("ways").alias("e")).select("src", "e.dst", "e.relation").where("dst is not null")
    start = orders.agg(F.min("note_id")).first()[0]
    return P.note_lineage(orders, edges, start, max_results=500)


@query("g5_candidates", f"""with {WALK}, {NOTES}, grams as (select id, depth, place, list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2])) as g from (select id, depth, place, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') as t from walk join note on note_id = id where id <> 's1')),
asked as (select list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2])) as q from (select 'building_7' as t))
select id, depth::int as depth, 1::bigint as support, len(list_intersect(g, q))::int as shared, len(list_distinct(list_concat(g, q)))::int as all_grams from grams, asked where len(list_intersect(g, q)) >= 3 order by len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) desc, depth, place, id limit 5""")
def candidates(spark, sf):
    walks = _walk(spark, sf).withColumn("seed", F.lit("s1")).withColumn("seed_place", F.lit(1))
    titles = _notes(spark, sf).select(F.col("note_id").alias("id"), "title")
    return P.select_candidates(walks, titles, "Building 7", most=5).drop("path")


@query("g7_adjacency", f"with {LINKS} select id, string_agg(n, ',' order by n) as neighbours from (select distinct src as id, dst as n from link union select distinct dst, src from link) group by 1")
def adjacency(spark, sf):
    return P.adjacency(_links(spark, sf)).select("id", F.array_join("neighbours", ",").alias("neighbours"))


@query("g10_projection_diff", f"""with {NOTES}, {LINKS}, old as (select * from note where project <> '3'), now as (select note_id, case when tags = ['BUILDING'] then 'x' else title end as title from note where project <> '4'),
a as (select 'node' as kind, coalesce(o.note_id, n.note_id) as id, case when o.note_id is null then 'added' when n.note_id is null then 'removed' when o.title <> n.title then 'updated' end as change from old o full join now n on o.note_id = n.note_id),
b as (select 'edge' as kind, edge_id as id, case relation when 'contains' then 'added' when 'wikilink' then 'removed' end as change from link) select * from a where change is not null union all select * from b where change is not null""")
def projection_diff(spark, sf):
    notes, links = _notes(spark, sf).select("note_id", "title", "project", "tags"), _links(spark, sf)
    title = F.when(F.array_contains("tags", "BUILDING"), "x").otherwise(F.col("title"))
    now = notes.where("project <> '4'").select("note_id", title.alias("title")), links.where("relation <> 'wikilink'")
    return P.projection_diff(now, (notes.where("project <> '3'").select("note_id", "title"), links.where("relation <> 'contains'")))


EVIDENCE = f"""{NOTES}, {LINKS}, hit as (select note_id as id from note where project in ('1', '2', '3')), ev as (select edge_id, src, dst, relation, case when relation = 'supersedes' then 'supersedes_candidate' when substr(dst, 2)::bigint % 2 = 0 then 'resume_path' else 'graph_proximity' end as signal from link where src in (from hit) and dst in (from hit))"""


def _evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    notes = _notes(spark, sf)
    hits = notes.where(F.col("project").isin("1", "2", "3")).select(F.col("note_id").alias("id"))
    kinds = notes.select(F.col("note_id").alias("id"), F.when(F.substring("note_id", 2, 18).cast("long") % 2 == 0, "job_plan").otherwise("note").alias("kind"))
    return hits, P.context_evidence(_links(spark, sf), hits, kinds)


@query("g12_context_evidence", f"with {EVIDENCE} select * from ev")
def context_evidence(spark, sf):
    return _evidence(spark, sf)[1]


@query("r20_evidence_enrichment", f"""with {EVIDENCE}, ends as (select src as id, edge_id from ev union select dst, edge_id from ev), five as (select * from ends qualify row_number() over (partition by id order by edge_id) <= 5)
select id, coalesce(string_agg(edge_id, ',' order by edge_id), '') as evidence from hit left join five using (id) group by 1""")
def evidence_enrichment(spark, sf):
    return P.with_evidence(*_evidence(spark, sf)).select("id", F.array_join("evidence", ",").alias("evidence"))


CENSUS = f"""{NOTES}, {LINKS}, e as (select distinct src, dst from link), deg as (select note_id, relative_path, (select count(*) from e where dst = note_id) as in_degree, (select count(*) from e where src = note_id) as out_degree, (select count(*) from link where dst = note_id and relation = 'contains') as parents,
  note_id in (select src from link where relation = 'wikilink' union select dst from link where relation = 'wikilink') as has_wikilink from note where project = '3'),
census as (select *, case when in_degree = 0 and out_degree = 0 then 'degree_zero,missing_canonical_parent' else 'missing_canonical_parent' end as debt from deg where parents = 0)"""


@query("g13_orphan_census", f"with {CENSUS} select * from census")
def orphan_census(spark, sf):
    return P.orphan_census(_notes(spark, sf), _links(spark, sf), "3").withColumn("debt", F.array_join("debt", ","))


@query("g15_census_history", f"with {CENSUS}, old as (select note_id, 100 as first_seen, 200 as last_seen, substr(note_id, 2)::bigint % 2 = 0 as acknowledged from note where project in ('3', '4')) select note_id, coalesce(first_seen, 300)::int as first_seen, case when c.note_id is null then last_seen else 300 end::int as last_seen, coalesce(acknowledged, false) as acknowledged from old full join census c using (note_id)")
def census_history(spark, sf):
    notes = _notes(spark, sf)
    old = notes.where(F.col("project").isin("3", "4")).select("note_id", F.lit(100).alias("first_seen"), F.lit(200).alias("last_seen"), (F.substring("note_id", 2, 18).cast("long") % 2 == 0).alias("acknowledged"))
    return P.observed(P.orphan_census(notes, _links(spark, sf), "3"), old, F.lit(300))


@query("g14_suggestions", f"""with {NOTES}, {LINKS}, e as (select src, dst from link union select dst, src from link), mine as (select dst from e where src = 'c2'), shared as (select src as note_id, count(distinct dst) as shared_neighbours from e where dst in (from mine) group by 1),
s as (select n.note_id as candidate, n.relative_path, len(list_intersect(list_transform(n.tags, lambda x: lower(x)), list_transform(o.tags, lambda x: lower(x))))::int as shared_tags, len(list_intersect(list_filter(string_split(lower(n.title), ' '), lambda x: length(x) > 1), list_filter(string_split(lower(o.title), ' '), lambda x: length(x) > 1)))::int as title_tokens, coalesce(shared_neighbours, 0) as shared_neighbours
  from note n join note o on o.note_id = 'c2' and n.project = o.project and n.note_id <> 'c2' left join shared on shared.note_id = n.note_id), t as (select *, (2 * shared_tags + title_tokens + 3 * least(shared_neighbours, 2))::int as score from s)
select candidate, ([0.0, 0.167, 0.333, 0.5, 0.667, 0.833, 1.0])[least(score, 6) + 1]::double as confidence, shared_tags, title_tokens, shared_neighbours, score from t where score > 0 order by confidence desc, relative_path limit 20""")
def suggestions(spark, sf):
    return P.relation_suggestions(_notes(spark, sf), _links(spark, sf), "c2")


@query("g16_issue_page", f"with {WRITTEN}, i as (select sha256(state || '␟' || edge_id) as issue_id, state as code, edge_id from state where state = 'MISSING') select * from i where issue_id > '1' order by 1 limit 50")
def issue_page(spark, sf):
    _, _, issues = P.projection(_notes(spark, sf), _written(spark, sf))
    return P.issue_page(issues, codes=["MISSING"], after="1")


@query("g17_link_validation", f"with {WRITTEN} select source_note_id, count(*) as parsed, count(*) filter (state = 'RESOLVED') as resolved, count(*) filter (state <> 'RESOLVED') as unresolved from state group by 1")
def link_validation(spark, sf):
    return P.link_validation(P.resolved(_written(spark, sf), _notes(spark, sf)))


@query("r19_graph_expansion", f"""with {WALK}, {NOTES}, grams as (select id, place, list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2])) as g from (select id, place, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') as t from walk join note on note_id = id)),
asked as (select list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2])) as q from (select 'household_12' as t))
select id, row_number() over (order by len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) desc, place) as new_rank from grams, asked qualify new_rank <= 40""")
def graph_expansion(spark, sf):
    walk = _walk(spark, sf)  # the notes found so far in their order, reranked by what their titles share with the query
    rated = walk.join(P.title_relevance(_notes(spark, sf).select(F.col("note_id").alias("id"), "title"), "HOUSEHOLD 12"), "id")
    order = [F.desc("relevance"), F.asc("place")]
    return rated.orderBy(*order).limit(40).select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("new_rank"))
