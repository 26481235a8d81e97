"""Many bounded walks over the note graph at once, the candidates they find, and search results widened by them.

A request has seeds; each seed walks by itself, breadth first, under its own cap. All walks of all requests
share one frontier, so the number of jobs grows with the depth alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.text import trigrams
from mnemospark.operators.graph import both_ways, checkpointed

#: Seeds of a request, visits of a seed, shared trigrams and candidates of a request (fixed values).
SEEDS, VISITS, LEAST_SHARED, MOST_CANDIDATES = 2, 50, 3, 3
WALK = ["request", "seed_place"]


def _steps(edges: DataFrame, direction: str, relations: tuple[str, ...]) -> DataFrame:
    e = (edges.where(F.col("relation").isin(list(relations))) if relations else edges).select("src", "dst")
    if direction == "in":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return checkpointed((both_ways(e) if direction == "both" else e).where("src != dst").distinct())


def walks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, direction: str = "both", relations: tuple[str, ...] = ("wikilink",), max_depth: int = 2, max_visits: int = VISITS) -> DataFrame:
    """request, seed_place, seed, id, depth, place (from 1, of its walk), parent of every visit. seeds: request,
    seed_place, seed; seeds that are no note (note_id of nodes) walk nowhere.

    Notes are met by the neighbours of earlier visits first, then by id; a walk ends at max_depth steps or
    max_visits notes. The edges are made once. A hub's neighbours are cut to the cap where they are found,
    before they are ranked."""
    e = _steps(edges, direction, relations)
    known = nodes.select(F.col("note_id").alias("seed")).distinct()
    start = seeds.join(known, "seed", "left_semi").select(*WALK, "seed", F.col("seed").alias("id"), F.lit(0).alias("depth"), F.lit(1).alias("place"))
    start = start.withColumn("parent", F.when(F.lit(False), F.col("seed")))
    seen = frontier = checkpointed(start)
    for d in range(1, max_depth + 1):
        reached = e.join(frontier.select(*WALK, "seed", F.col("id").alias("src"), "place"), "src")
        reached = reached.groupBy(*WALK, "seed", F.col("dst").alias("id")).agg(F.min(F.struct("place", "src")).alias("_from"))
        new = reached.join(seen.select(*WALK, "id"), [*WALK, "id"], "left_anti")
        n = F.row_number().over(Window.partitionBy(*WALK).orderBy("_from.place", "id"))
        top = new.withColumn("_n", n).where(F.col("_n") <= max_visits)  # a constant bound is applied before the rows move
        counts = seen.groupBy(*WALK).agg(F.count(F.lit(1)).alias("_c"))
        top = top.join(counts, WALK).withColumn("place", (F.col("_c") + F.col("_n")).cast("int")).where(F.col("place") <= max_visits)
        frontier = checkpointed(top.select(*WALK, "seed", "id", F.lit(d).alias("depth"), "place", F.col("_from.src").alias("parent")))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen


def truncated(visits: DataFrame, edges: DataFrame, direction: str = "both", relations: tuple[str, ...] = ("wikilink",)) -> DataFrame:
    """request, seed_place of the walks of which some visited note has a neighbour that is not visited."""
    beyond = _steps(edges, direction, relations).join(visits.select(*WALK, F.col("id").alias("src")), "src").select(*WALK, F.col("dst").alias("id"))
    return beyond.join(visits.select(*WALK, "id"), [*WALK, "id"], "left_anti").select(*WALK).distinct()


def relevance(title: Column, query: Column) -> Column:
    """shared and all_grams: trigrams of a title and a query in common, and in either."""
    return F.struct(F.size(F.array_intersect(title, query)).alias("shared"), F.size(F.array_union(title, query)).alias("all_grams"))


def candidates(visits: DataFrame, titles: DataFrame, queries: DataFrame, *, least: int = LEAST_SHARED, most: int = MOST_CANDIDATES) -> DataFrame:
    """request, id, seed_place, depth, support, shared, all_grams, place of the best notes that each request's
    walks met, seeds left out. titles: id, title; queries: request, query.

    depth is the least over the seeds, seed_place the first seed that has it, support the number of seeds. A
    title must share least trigrams with the query. Order: the share of trigrams in common (equal quotients of
    small integers are equal doubles), less depth, more support, first met, id."""
    own = visits.where("depth = 0").select("request", "id")
    met = visits.join(own, ["request", "id"], "left_anti").groupBy("request", "id").agg(
        F.min(F.struct("depth", "seed_place")).alias("_near"), F.count(F.lit(1)).alias("support"), F.min(F.struct("seed_place", "place")).alias("_first"),
    )
    t = met.join(titles.select("id", trigrams(F.col("title")).alias("_t")), "id").join(queries.select("request", trigrams(F.col("query")).alias("_q")), "request")
    t = t.withColumn("_r", relevance(F.col("_t"), F.col("_q"))).where(F.col("_r.shared") >= least)
    order = [F.desc(F.col("_r.shared") / F.col("_r.all_grams")), F.asc("_near.depth"), F.desc("support"), F.asc("_first"), F.asc("id")]
    ranked = t.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(*order))).where(F.col("place") <= most)
    return ranked.select("request", "id", "_near.seed_place", "_near.depth", "support", "_r.shared", "_r.all_grams", "place")


def path_hops(found: DataFrame, visits: DataFrame, edges: DataFrame, relations: tuple[str, ...] = ("wikilink",)) -> DataFrame:
    """request, id, hop (from 1, at the seed), src, dst, edge_id, forward of the way by which each candidate was
    met: back over the parents, as many joins as the longest way has steps. Of several edges the first by
    edge_id counts; forward tells whether it leads from src to dst."""
    deepest = found.agg(F.max("depth")).first()[0] or 0
    at = found.select(*WALK, "id", "depth", F.col("id").alias("at"))
    back = visits.select(*WALK, F.col("id").alias("at"), "parent")
    hops = None
    for _ in range(deepest):
        at = at.where("depth > 0").join(back, [*WALK, "at"])
        step = at.select("request", "id", F.col("depth").alias("hop"), F.col("parent").alias("src"), F.col("at").alias("dst"))
        hops = step if hops is None else hops.unionByName(step)
        at = at.select(*WALK, "id", (F.col("depth") - 1).alias("depth"), F.col("parent").alias("at"))
    if hops is None:
        empty = found.select("request", "id", F.lit(0).alias("hop"), F.col("id").alias("src"), F.col("id").alias("dst"))
        hops = empty.where(F.lit(False))
    e = edges.where(F.col("relation").isin(list(relations))) if relations else edges
    ways = e.select("src", "dst", "edge_id", F.lit(True).alias("forward")).union(e.select("dst", "src", "edge_id", F.lit(False)))
    met = hops.join(ways, ["src", "dst"]).groupBy("request", "id", "hop", "src", "dst").agg(F.min(F.struct("edge_id", (~F.col("forward")).alias("_b"))).alias("_e"))
    return met.select("request", "id", "hop", "src", "dst", "_e.edge_id", (~F.col("_e._b")).alias("forward"))


def first_chunks(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """id, chunk_index, content of the first chunk of each note (id) that is not blank; notes without one are
    left out. chunks: id, chunk_index, content."""
    rows = chunks.join(notes.select("id").distinct(), "id", "left_semi").where(F.col("content").rlike(r"\S"))
    return rows.groupBy("id").agg(F.min_by(F.struct("chunk_index", "content"), "chunk_index").alias("_c")).select("id", "_c.*")


def expanded(primary: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, titles: DataFrame, chunks: DataFrame, *, depth: int = 2, limit: int = 10, keep: DataFrame | None = None) -> DataFrame:
    """request, place, id, shared, all_grams, score, from_graph, content of each request's results, widened by what
    walks from its first SEEDS notes meet and reranked by what titles share with the query.

    primary: request, rank, id, as recalled. Candidates that are in primary are no news; of the others those
    that keep (ids that may be shown) allows and that have text come in. The union is ordered by the
    share of trigrams, then as it was: recalled notes by rank, then candidates by place."""
    first = primary.groupBy("request", "id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("rank", "id"))
    seeds = first.withColumn("seed_place", place).where(F.col("seed_place") <= SEEDS).select(*WALK, F.col("id").alias("seed"))
    visits = walks(nodes, edges, seeds, max_depth=depth)
    new = candidates(visits, titles, queries).join(first, ["request", "id"], "left_anti")
    new = new if keep is None else new.join(keep.select("id").distinct(), "id", "left_semi")
    shown = first_chunks(chunks, new.select("id").union(first.select("id")))
    new = new.join(shown.select("id"), "id", "left_semi")
    union = first.select("request", "id", F.struct(F.lit(0).alias("late"), F.col("rank").cast("long").alias("n")).alias("_o")).union(new.select("request", "id", F.struct(F.lit(1), F.col("place").cast("long"))))
    rated = union.join(titles.select("id", trigrams(F.col("title")).alias("_t")), "id").join(queries.select("request", trigrams(F.col("query")).alias("_q")), "request")
    rated = rated.withColumn("_r", relevance(F.col("_t"), F.col("_q"))).select("request", "id", "_o", "_r.*")
    share = F.when(F.col("all_grams") > 0, F.col("shared") / F.col("all_grams")).otherwise(0.0)
    ranked = rated.withColumn("score", share).withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "_o", "id"))).where(F.col("place") <= limit)
    return ranked.join(shown.select("id", "content"), "id", "left").select("request", "place", "id", "shared", "all_grams", "score", (F.col("_o.late") == 1).alias("from_graph"), "content")
