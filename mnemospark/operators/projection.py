"""The note graph as it is read: projection, bounded walks, candidates, evidence, census, suggestions.

Notes: note_id, relative_path, title, project, aliases (array), tags (array), index_status. Edges:
edge_id, source_note_id, source_path, target_note_id, target_path, relation, confidence, source_kind.
A projection has nodes (notes that are indexed) and edges with src and dst (note ids)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.text import jaccard, trigrams
from mnemospark.operators.graph import both_ways, checkpointed
from mnemospark.operators.rows import snapshot_diff, with_running_sum

#: What an edge between recalled notes says, by relation, then by the kind of its target (fixed values).
SIGNALS = {"duplicates": "duplicate_candidate", "supersedes": "supersedes_candidate", "blocks": "impact_analysis", "resolves": "impact_analysis", "contradicts": "impact_analysis", "derived_from": "lineage", "promotes_to": "lineage", "supports": "lineage", "extends": "lineage"}
RESUME_KINDS = ["memory_compact", "job_plan", "implementation_history"]
#: Confidence of a suggested relation by its score (fixed values).
CONFIDENCE = [0.0, 0.167, 0.333, 0.5, 0.667, 0.833, 1.0]


def folded(text: Column) -> Column:
    """A name as links compare it: canonical composition, full case folding. Neither is a built-in."""

    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFC").str.casefold().str.normalize("NFC")

    return fold(text)


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, the first by all other columns."""
    rest = [F.to_json(F.struct(*[c for c in df.columns if c != key]))]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*rest))).where("_r = 1").drop("_r")


def resolved(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """edges with dst and state: RESOLVED by note id, else by path, else by the one note that has the
    link's name (file stem, title or alias); AMBIGUOUS where several have it; TARGET_NOT_INDEXED where
    only notes that aren't indexed would do; else MISSING."""
    indexed = F.col("index_status") == "indexed"
    ids = notes.groupBy(F.col("note_id").alias("target_note_id")).agg(F.min(F.when(indexed, F.col("note_id"))).alias("_by_id"), F.lit(True).alias("_id_known"))
    paths = notes.groupBy(folded(F.col("relative_path")).alias("_path")).agg(F.min(F.when(indexed, F.col("note_id"))).alias("_by_path"), F.lit(True).alias("_path_known"))
    stem = F.regexp_replace(F.regexp_extract("relative_path", r"([^/]*)$", 1), r"\.md$", "")
    names = notes.select("note_id", "index_status", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(stem, "title"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("_n"))
    names = names.select("note_id", "index_status", folded(F.col("_n")).alias("_name")).distinct()
    names = names.groupBy("_name").agg(F.min(F.when(indexed, F.col("note_id"))).alias("_by_name"), F.count_if(indexed).alias("_many"), F.lit(True).alias("_name_known"))
    link = F.regexp_replace(F.regexp_extract("target_path", r"([^/]*)$", 1), r"\.md$", "")
    rows = edges.withColumn("_path", folded(F.col("target_path"))).withColumn("_name", folded(link))
    rows = rows.join(ids, "target_note_id", "left").join(paths, "_path", "left").join(names, "_name", "left")
    dst = F.coalesce("_by_id", "_by_path", F.when(F.col("_many") == 1, F.col("_by_name")))
    known = F.coalesce("_id_known", "_path_known", "_name_known", F.lit(False))
    state = F.when(dst.isNotNull(), "RESOLVED").when(F.col("_many") > 1, "AMBIGUOUS").when(known, "TARGET_NOT_INDEXED").otherwise("MISSING")
    return rows.select(*edges.columns, dst.alias("dst"), state.alias("state"))


def projection(notes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges (those resolved, from indexed notes) and issues (edge_id, code)."""
    notes = distinct_rows(notes, "note_id")
    found = resolved(distinct_rows(edges, "edge_id"), notes)
    nodes = notes.where("index_status = 'indexed'")
    sources = nodes.select(F.col("note_id").alias("source_note_id"))
    good = found.where("state = 'RESOLVED'").join(sources, "source_note_id", "left_semi").withColumn("src", F.col("source_note_id"))
    broken = notes.where("index_status = 'error'").select(F.lit(None).cast("string").alias("edge_id"), F.lit("INDEX_ERROR").alias("code"), F.col("note_id").alias("source_note_id"))
    unresolved = found.where("state != 'RESOLVED'").select("edge_id", F.col("state").alias("code"), "source_note_id")
    return nodes, good, unresolved.unionByName(broken)


def projection_metrics(nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """name, n: sizes of a projection and its issues by code."""
    n = F.count(F.lit(1)).alias("n")
    return nodes.agg(n).select(F.lit("nodes").alias("name"), "n").union(edges.agg(n).select(F.lit("edges"), "n")).union(issues.groupBy("code").agg(n))


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with batch: rows in order (without ties), size to a batch, from 0."""
    counted = with_running_sum(df.withColumn("_one", F.lit(1)), order, "_one", "_place")
    return counted.withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_one", "_place")


def _steps(edges: DataFrame, direction: str, relations: list[str]) -> DataFrame:
    e = edges.where(F.col("relation").isin(relations)) if relations else edges
    e = e.select("src", "dst")
    if direction == "in":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return (both_ways(e) if direction == "both" else e).where("src != dst").distinct()


def traverse(nodes: DataFrame, edges: DataFrame, start, *, direction: str = "out", relations: tuple[str, ...] = (), max_depth: int = 2, max_results: int = 50) -> DataFrame:
    """id, depth, place (from 1), path, truncated of the notes that a walk breadth first from start meets:
    neighbours in the order of their ids, those of earlier notes first, at most max_depth steps and
    max_results notes. truncated: some visited note has a neighbour that is not visited. No such start: none.

    Each step joins the frontier, as small as max_results, with the edges; the places within a step
    are given to max_results rows at most."""
    e = checkpointed(_steps(edges, direction, list(relations)))  # once, for all steps
    kind = dict(nodes.dtypes)["note_id"]
    spark = nodes.sparkSession
    if not nodes.where(F.col("note_id") == F.lit(start)).take(1):
        return spark.createDataFrame([], f"id {kind}, depth int, place int, path array<{kind}>, truncated boolean")
    seen = frontier = spark.createDataFrame([(start, 0, 1, [start])], f"id {kind}, depth int, place int, path array<{kind}>")
    total = 1
    for d in range(1, max_depth + 1):
        if total >= max_results:
            break
        reached = e.join(F.broadcast(frontier), e["src"] == frontier["id"]).select(F.col("dst").alias("id"), F.struct("place", "path").alias("_from"))
        reached = reached.groupBy("id").agg(F.min("_from").alias("_from")).join(F.broadcast(seen.select("id")), "id", "left_anti")
        top = reached.orderBy("_from.place", "id").limit(max_results - total)
        place = F.row_number().over(Window.orderBy("_from.place", "id")) + total
        frontier = checkpointed(top.select("id", F.lit(d).alias("depth"), place.alias("place"), F.concat("_from.path", F.array("id")).alias("path")))
        n = frontier.count()
        if not n:
            break
        seen, total = seen.unionByName(frontier), total + n
    beyond = e.join(F.broadcast(seen.select(F.col("id").alias("src"))), "src", "left_semi").join(F.broadcast(seen.select(F.col("id").alias("dst"))), "dst", "left_anti")
    return seen.withColumn("truncated", F.lit(not beyond.isEmpty()))


def note_lineage(nodes: DataFrame, edges: DataFrame, start, max_depth: int = 8, max_results: int = 50) -> DataFrame:
    """id, depth, way of what a note supersedes and is superseded by, itself left out."""
    walk = lambda direction, way: traverse(nodes, edges, start, direction=direction, relations=("supersedes",), max_depth=max_depth, max_results=max_results + 1).where("depth > 0").select("id", "depth", F.lit(way).alias("way"))
    return walk("out", "supersedes").unionByName(walk("in", "superseded_by"))


def select_candidates(walks: DataFrame, titles: DataFrame, query: str, *, least: int = 3, most: int = 3) -> DataFrame:
    """id, depth, support, shared, all_grams, path of the best notes that walks from seeds met.

    walks: seed_place, seed, id, depth, place, path. A note's depth is its least, its support the number of
    seeds; its title must share least trigrams with the query. Order: the share of common trigrams
    (a quotient of two small integers, so equal shares are equal doubles), less depth, more support,
    first met, id."""
    seeds = walks.select(F.col("seed").alias("id")).distinct()
    met = walks.join(seeds, "id", "left_anti").groupBy("id").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("support"), F.min(F.struct("seed_place", "place")).alias("_first"), F.min_by("path", F.struct("depth", "seed_place", "place")).alias("path"))
    asked = trigrams(F.lit(query))
    t = met.join(titles.select("id", trigrams(F.col("title")).alias("_t")), "id")
    t = t.withColumn("shared", F.size(F.array_intersect("_t", asked))).withColumn("all_grams", F.size(F.array_union("_t", asked)))
    order = [F.desc(F.col("shared") / F.col("all_grams")), F.asc("depth"), F.desc("support"), F.asc("_first"), F.asc("id")]
    return t.where(F.col("shared") >= least).orderBy(*order).limit(most).select("id", "depth", "support", "shared", "all_grams", "path")


def title_relevance(titles: DataFrame, query: str) -> DataFrame:
    """id and the share of trigrams that its title has in common with the query."""
    return titles.select("id", jaccard(trigrams(F.col("title")), trigrams(F.lit(query))).alias("relevance"))


def adjacency(edges: DataFrame) -> DataFrame:
    """id and neighbours: the ids next to it, either way, in order. As long as the note has neighbours."""
    return both_ways(edges.select("src", "dst")).where("src != dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def projection_diff(now: tuple[DataFrame, DataFrame], then: tuple[DataFrame, DataFrame]) -> DataFrame:
    """kind (node, edge), id, change between two projections (nodes by note_id, edges by edge_id)."""
    def diff(new: DataFrame, old: DataFrame, key: str, kind: str) -> DataFrame:
        digest = lambda df: df.select(F.col(key).alias("id"), F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256).alias("_h"))
        return snapshot_diff(digest(new), digest(old), "id", "_h").select(F.lit(kind).alias("kind"), "id", "change")

    return diff(now[0], then[0], "note_id", "node").unionByName(diff(now[1], then[1], "edge_id", "edge"))


def evidence_signal(relation: Column, target_kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])[relation]
    return F.coalesce(known, F.when(target_kind.isin(RESUME_KINDS), "resume_path"), F.lit("graph_proximity"))


def context_evidence(edges: DataFrame, recalled: DataFrame, kinds: DataFrame) -> DataFrame:
    """edge_id, src, dst, relation, signal of the edges between recalled notes (id); kinds: id, kind."""
    ends = recalled.select("id").distinct()
    e = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.join(kinds.select(F.col("id").alias("dst"), "kind"), "dst", "left")
    return e.select("edge_id", "src", "dst", "relation", evidence_signal(F.col("relation"), F.col("kind")).alias("signal"))


def with_evidence(recalled: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """recalled (id, rank, ...) with evidence: the first most edge ids (in order) that a note is an end of."""
    ends = evidence.select(F.col("src").alias("id"), "edge_id").union(evidence.select(F.col("dst").alias("id"), "edge_id")).distinct()
    first = ends.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("edge_id"))).where(F.col("_r") <= most)
    lists = first.groupBy("id").agg(F.array_sort(F.collect_list("edge_id")).alias("evidence"))
    return recalled.join(lists, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def orphan_census(nodes: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    """note_id, relative_path, in_degree, out_degree, parents, has_wikilink, debt of the notes without
    links or without a note that contains them. Edges of all projects count; listed are those of one."""
    pairs = edges.select("src", "dst").distinct()
    into = pairs.groupBy(F.col("dst").alias("note_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = pairs.groupBy(F.col("src").alias("note_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    parents = edges.where("relation = 'contains'").groupBy(F.col("dst").alias("note_id")).agg(F.count(F.lit(1)).alias("parents"))
    wiki = edges.where("relation = 'wikilink' or source_kind = 'wikilink'")
    wiki = wiki.select(F.col("src").alias("note_id")).union(wiki.select(F.col("dst").alias("note_id"))).distinct().withColumn("has_wikilink", F.lit(True))
    rows = nodes.where(F.col("project") == project) if project is not None else nodes
    for side in (into, out, parents, wiki):
        rows = rows.join(side, "note_id", "left")
    rows = rows.fillna(0, ["in_degree", "out_degree", "parents"]).fillna(False, ["has_wikilink"])
    debt = F.array_compact(F.array(F.when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "degree_zero"), F.when(F.col("parents") == 0, "missing_canonical_parent")))
    return rows.withColumn("debt", debt).where(F.size("debt") > 0).select("note_id", "relative_path", "in_degree", "out_degree", "parents", "has_wikilink", "debt")


def observed(census: DataFrame, history: DataFrame, at: Column) -> DataFrame:
    """The census history after one more census at a moment: note_id, first_seen, last_seen, acknowledged.
    A note that is no orphan any more keeps its row as it was."""
    now = census.select("note_id").distinct().withColumn("_at", at)
    both = history.join(now, "note_id", "full_outer")
    return both.select("note_id", F.least("first_seen", "_at").alias("first_seen"), F.greatest("last_seen", "_at").alias("last_seen"), F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"))


def relation_suggestions(nodes: DataFrame, edges: DataFrame, seed, most: int = 20) -> DataFrame:
    """candidate, confidence, shared_tags, title_tokens, shared_neighbours, score of notes of the seed's
    project (of all, where it has none) that have something in common with it: 2 points a tag, 1 a
    word of the title (over one letter), 3 a neighbour, two neighbours at most. Best first, then path."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: F.length(w) > 1))
    tags = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))))
    own = nodes.where(F.col("note_id") == F.lit(seed)).select("project", tags(F.col("tags")).alias("t"), words(F.col("title")).alias("w")).take(1)
    one = own[0] if own else {"project": None, "t": [], "w": []}
    near = both_ways(edges.select("src", "dst")).where("src != dst").distinct()
    mine = near.where(F.col("src") == F.lit(seed)).select("dst")
    shared = near.join(mine, "dst", "left_semi").groupBy(F.col("src").alias("note_id")).agg(F.count(F.lit(1)).alias("shared_neighbours"))
    literal = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    rows = nodes.where(F.col("note_id") != F.lit(seed)) if own else nodes.where(F.lit(False))
    rows = rows.where(F.col("project") == one["project"]) if one["project"] is not None else rows
    rows = rows.join(shared, "note_id", "left").fillna(0, ["shared_neighbours"])
    rows = rows.withColumn("shared_tags", F.size(F.array_intersect(tags(F.col("tags")), literal(one["t"])))).withColumn("title_tokens", F.size(F.array_intersect(words(F.col("title")), literal(one["w"]))))
    score = 2 * F.col("shared_tags") + F.col("title_tokens") + 3 * F.least("shared_neighbours", F.lit(2))
    rows = rows.withColumn("score", score.cast("int")).where("score > 0")
    sure = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.least(F.col("score"), F.lit(6)) + 1)
    return rows.withColumn("confidence", sure).orderBy(F.desc("confidence"), "relative_path").limit(most).select(F.col("note_id").alias("candidate"), "confidence", "shared_tags", "title_tokens", "shared_neighbours", "score")


def issue_page(issues: DataFrame, *, codes: list[str] | None = None, after: str | None = None, size: int = 50) -> DataFrame:
    """issue_id, code, edge_id of the next issues after a cursor (an issue_id), in the order of their ids."""
    rows = issues.where(F.col("code").isin(codes)) if codes else issues
    rows = rows.select(F.sha2(F.concat_ws("␟", "code", F.coalesce("edge_id", F.lit(""))), 256).alias("issue_id"), "code", "edge_id")
    return (rows.where(F.col("issue_id") > after) if after else rows).orderBy("issue_id").limit(size)


def link_validation(found: DataFrame) -> DataFrame:
    """source_note_id, parsed, resolved, unresolved: the links of each note."""
    good = F.count_if(F.col("state") == "RESOLVED")
    return found.groupBy("source_note_id").agg(F.count(F.lit(1)).alias("parsed"), good.alias("resolved"), (F.count(F.lit(1)) - good).alias("unresolved"))
