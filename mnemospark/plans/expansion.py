"""Queries of walks from several seeds of many requests: every fiftieth customer asks for its own title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import expansion
from mnemospark.plans.notes_graph import LINKS, NOTES, _links, _notes
from mnemospark.plans.registry import query
from mnemospark.session import table

GRAMS = r"list_distinct(list_transform(range(1, length(t) - 1), lambda i: t[i:i+2]))"
FLAT = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_')"
VISITS = f"""{NOTES}, {LINKS}, req as materialized (select c_custkey as request, c_mktsegment || ' ' || c_nationkey as query from customer where c_custkey % 50 = 0),
prim as (select request, 1 as rank, 'c' || request as id from req union all select request, 2, 'c' || (request + 1) from req union all select request, 3, 's1' from req),
step as materialized (select distinct src, dst from link where relation = 'wikilink' union select distinct dst, src from link where relation = 'wikilink'),
seed as materialized (select request, rank as sp, id from prim where rank <= 2 and id in (select note_id from note)),
one as materialized (select request, sp, dst as id, 1 + row_number() over (partition by request, sp order by dst) as place, seed.id as parent from seed join step on src = seed.id qualify place <= 50),
size as materialized (select request, sp, count(*) + 1 as c from one group by 1, 2),
far as materialized (select one.request, one.sp, dst as id, min(one.place) as p, arg_min(one.id, one.place) as parent from one join step on src = one.id group by 1, 2, 3),
two as materialized (select request, sp, id, c + row_number() over (partition by request, sp order by p, id) as place, parent from far join size using (request, sp) anti join one using (request, sp, id) anti join seed using (request, sp, id) qualify place <= 50),
visit as materialized (select request, sp, id, 0 as depth, 1 as place, null as parent from seed union all select request, sp, id, 1, place, parent from one union all select request, sp, id, 2, place, parent from two)"""
FOUND = rf"""{VISITS}, titled as (select note_id as id, {GRAMS} as g from (select note_id, {FLAT.format("title")} as t from note)), asked as (select request, {GRAMS} as q from (select request, {FLAT.format("query")} as t from req)),
met as (select request, id, min([depth, sp]) as near, count(*) as support, min([sp, place]) as first from visit anti join seed using (request, id) group by 1, 2),
cand as materialized (select request, id, near[2] as sp, near[1] as depth, support, shared, all_grams, row_number() over (partition by request order by shared / all_grams desc, near[1], support desc, first, id) as place
  from (select met.*, len(list_intersect(g, q)) as shared, len(list_distinct(list_concat(g, q))) as all_grams from met join titled using (id) join asked using (request)) where shared >= 3 qualify place <= 3)"""


def _requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The queries, and three notes that were recalled for each."""
    c = table(spark, sf, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("request"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("query"))
    note = lambda rank, name: F.struct(F.lit(rank).alias("rank"), name.alias("id"))
    found = F.array(note(1, F.concat(F.lit("c"), "request")), note(2, F.concat(F.lit("c"), F.col("request") + 1)), note(3, F.lit("s1")))
    return c, c.select("request", F.explode(found).alias("p")).select("request", "p.*")


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(spark, sf).select(F.col("note_id").alias("id"), "title")


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    _, primary = _requests(spark, sf)
    seeds = primary.where("rank <= 2").select("request", F.col("rank").alias("seed_place"), F.col("id").alias("seed"))
    return expansion.walks(_notes(spark, sf), _links(spark, sf), seeds)


@query("g3_many_walks", f"with {VISITS} select request, sp::int as seed_place, id, depth::int as depth, place::int as place, coalesce(parent, '-') as parent from visit")
def many_walks(spark, sf):
    return _visits(spark, sf).select("request", "seed_place", "id", "depth", "place", F.coalesce("parent", F.lit("-")).alias("parent"))


@query("g5_two_seeds", f"with {FOUND} select request, id, sp::int as seed_place, depth::int as depth, support, shared::int as shared, all_grams::int as all_grams, place::int as place from cand")
def two_seeds(spark, sf):
    return expansion.candidates(_visits(spark, sf), _titles(spark, sf), _requests(spark, sf)[0])


@query("g5_path_hops", f"""with {FOUND}, hop as (select c.request, c.id, v.depth as hop, v.parent as src, v.id as dst from cand c join visit v on v.request = c.request and v.sp = c.sp and v.id = c.id where c.depth > 0
  union all select c.request, c.id, 1, w.parent, w.id from cand c join visit v on v.request = c.request and v.sp = c.sp and v.id = c.id join visit w on w.request = c.request and w.sp = c.sp and w.id = v.parent where c.depth = 2)
select request, hop.id, hop::int as hop, hop.src, hop.dst, min(edge_id) as edge_id, bool_or(link.src = hop.src) as forward from hop join link on relation = 'wikilink' and ((link.src = hop.src and link.dst = hop.dst) or (link.src = hop.dst and link.dst = hop.src)) group by all""")
def path_hops(spark, sf):
    visits = _visits(spark, sf)
    return expansion.path_hops(expansion.candidates(visits, _titles(spark, sf), _requests(spark, sf)[0]), visits, _links(spark, sf))


CHUNKS = """chunk as (select 'c' || c_custkey as id, unnest([{'i': 0, 't': case when c_nationkey % 4 = 0 then '  ' else c_name end}, {'i': 1, 't': case when c_nationkey % 8 = 0 then '' else c_mktsegment end}]) as x from customer union all select 's' || s_suppkey, {'i': 0, 't': s_name} from supplier),
shown as (select id, arg_min(x.t, x.i) as content from chunk where regexp_matches(x.t, '\\S') group by 1)"""


@query("r19_two_seeds", f"""with {FOUND}, {CHUNKS}, u as (select request, id, 0 as late, rank as n from prim union all select request, id, 1, place from cand anti join prim using (request, id) where id in (select id from shown)),
r as (select u.*, len(list_intersect(g, q)) as shared, len(list_distinct(list_concat(g, q))) as all_grams from u join titled using (id) join asked using (request))
select request, row_number() over (partition by request order by shared / all_grams desc, late, n, id)::int as place, id, shared::int as shared, all_grams::int as all_grams, late = 1 as from_graph, coalesce(content, '-') as content from r left join shown using (id)""")
def graph_expansion(spark, sf):
    queries, primary = _requests(spark, sf)
    chunk = lambda i, t: F.struct(F.lit(i).alias("chunk_index"), t.alias("content"))
    texts = F.array(chunk(0, F.when(F.col("c_nationkey") % 4 == 0, "  ").otherwise(F.col("c_name"))), chunk(1, F.when(F.col("c_nationkey") % 8 == 0, "").otherwise(F.col("c_mktsegment"))))
    chunks = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.explode(texts).alias("x")).select("id", "x.*")
    chunks = chunks.union(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit(0), "s_name"))
    found = expansion.expanded(primary, queries, _notes(spark, sf), _links(spark, sf), _titles(spark, sf), chunks)
    return found.select("request", "place", "id", "shared", "all_grams", "from_graph", F.coalesce("content", F.lit("-")).alias("content"))
