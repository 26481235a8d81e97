"""The note graph as two DataFrames: nodes (id) and edges (src, dst, relation, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.session import shared_folder

#: Weights of relations for related notes (fixed values); others weigh 0.4.
WEIGHTS = {"derived_from": 1.0, "cites": 0.9, "supersedes": 0.8, "promotes_to": 0.8, "duplicates": 0.8, "supports": 0.7, "extends": 0.7, "related": 0.6, "wikilink": 0.5}


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the cluster's checkpoint folder, so that loops stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_round(df: DataFrame, folder: str, n: int) -> DataFrame:
    """Round n of a loop that joins its rows with themselves, as Parquet in folder, in place of round n - 1.

    A checkpoint keeps Spark's estimate of its size, which for a join is the product of both sides: joined with
    itself its digits double each round, until planning fills the driver. Files have the size they have."""
    spark = df.sparkSession
    df.write.parquet(f"{folder}/{n}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(f"{folder}/{n}")


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def degrees(nodes: DataFrame, edges: DataFrame, distinct: bool = False) -> DataFrame:
    """id, out_degree, in_degree of every node (distinct neighbours). distinct: no edge comes twice. Edges are read once: both ends of
    each different edge count in one sum, partly before they move, so a hub is no burden."""
    e = edges.select("src", "dst") if distinct else edges.select("src", "dst").distinct()
    end = lambda c, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = e.select(F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("id").join(sums, "id", "left").fillna(0, ["out_degree", "in_degree"])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return nodes.select("id").join(ends, "id", "left_anti")


def related(edges: DataFrame, seed) -> DataFrame:
    """The neighbours of seed with their best edge: weight of its relation plus its confidence; ties
    by edge id."""
    near = both_ways(edges.where((F.col("src") == seed) | (F.col("dst") == seed))).where((F.col("src") == seed) & (F.col("dst") != seed))
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    scored = near.withColumn("score", F.coalesce(weights[F.col("relation")], F.lit(0.4)) + F.col("confidence"))
    first = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("score"), "edge_id"))
    return scored.withColumn("_r", first).where("_r = 1").select(F.col("dst").alias("neighbour"), "relation", "edge_id", "score")


def reach(edges: DataFrame, start, depth: int, directed: bool = True) -> DataFrame:
    """id and depth of all nodes within depth steps of start, each at its least depth. The frontier
    alone is joined in each step; steps are as few as the depth asked for."""
    e = checkpointed((edges if directed else both_ways(edges)).select("src", "dst").distinct())
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], f"id {dict(edges.dtypes)['src']}, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        nxt = e.join(frontier, e["src"] == frontier["id"]).select(F.col("dst").alias("id")).distinct()
        frontier = checkpointed(nxt.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that links lead to, either way), by label propagation with
    shortcuts: a label also takes on its label's label, so long chains halve each round. Rounds go
    on until no label moves."""
    e = checkpointed(both_ways(edges.select("src", "dst")).distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        low = e.join(labels, e["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("low"))
        new = labels.join(low, labels["id"] == low["src"], "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"))
        hop = new.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        new = checkpointed(new.join(hop, new["component"] == hop["_i"], "left").select("id", F.coalesce(F.least("component", "_c"), "component").alias("component")))
        moved = new.join(labels.withColumnRenamed("component", "_old"), "id").where("component != _old").limit(1).count()
        labels = new
        if not moved:
            break
    return labels


def _shortened(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """e (src, dst, each once, no self links) with its chains, nodes that have one link in and one out, as single links; their nodes
    (id, src, dst: from where to where their chain leads); and rings (id, cycle) of such nodes alone. None without any.
    Steps along a chain double, so one of 10,000 nodes takes 14 joins."""
    one = lambda c, other, as_: e.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias(as_)).where("n = 1").drop("n")
    plain = checkpointed(one("dst", "src", "before").join(one("src", "dst", "after"), "id"))
    n = plain.count()
    if not n:
        return None
    ids = plain.select(F.col("id").alias("_id"), F.lit(True).alias("_in"))
    first = F.when(F.col("_in"), F.col("after")).otherwise(F.col("id"))
    walk = checkpointed(plain.join(ids, plain["after"] == ids["_id"], "left").select("id", first.alias("at"), F.col("_in").isNotNull().alias("on"), F.least("id", first).alias("low")))
    steps = 1
    while steps <= n and walk.where("on").limit(1).count():
        far = walk.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("on").alias("_on"), F.col("low").alias("_low"))
        walk = checkpointed(walk.join(far, "at").select("id", F.col("_at").alias("at"), F.col("_on").alias("on"), F.least("low", "_low").alias("low")))
        steps *= 2
    lines = walk.where("not on").select("id", "at").join(plain, "id")
    begin = lines.join(ids, lines["before"] == ids["_id"], "left_anti").select("at", F.col("before").alias("src"))
    chains = begin.join(plain.select(F.col("id").alias("at"), F.col("after").alias("dst")), "at")
    members = checkpointed(lines.select("id", "at").join(chains, "at").select("id", "src", "dst"))
    rest = e.join(ids, e["src"] == ids["_id"], "left_anti").join(ids, F.col("dst") == F.col("_id"), "left_anti")
    rest = rest.unionByName(members.where("src != dst").select("src", "dst")).distinct()
    return checkpointed(rest), members, walk.where("on").select("id", F.col("low").alias("cycle"))


def cycles(edges: DataFrame) -> DataFrame:
    """id and cycle (its smallest member) of all nodes on a directed cycle, self links among them.

    Nodes without a link in or out are on none and are trimmed, and chains become single links, until all
    nodes have both and several of one: in turn, so that trees and chains of any depth take few rounds. Then every
    node takes the largest id that leads to it as its colour; what reaches a colour's own node within
    the colour is one strongly connected set. Sets found leave the graph, and the rest goes on. At last the nodes of
    chains that lead from a set into itself join it. Each round is joins on node ids, cut from its lineage; every
    colour yields a set each round."""
    loops = edges.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("cycle")).distinct()
    e = checkpointed(edges.where("src != dst").select("src", "dst").distinct())
    found, shortened = loops.limit(0), []
    while True:
        n = -1
        while n != (n := e.count()):
            heads, tails = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
            e = checkpointed(e.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
            if parts := _shortened(e):
                e, members, rings = parts
                shortened.append(members)
                found = found.unionByName(rings)
        if n == 0:
            break
        colours = checkpointed(e.select(F.col("src").alias("id"), F.col("src").alias("colour")).distinct())
        moved = 1
        while moved:
            high = e.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("_high"))
            new = colours.join(high, "id", "left").select("id", F.greatest("colour", "_high").alias("colour"), (F.col("_high") > F.col("colour")).alias("_moved"))
            new = checkpointed(new)
            moved, colours = new.where("_moved").limit(1).count(), new.select("id", "colour")
        tinted = e.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("_a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("_b")), "dst")
        inner = checkpointed(tinted.where("_a = _b").select("src", "dst"))
        members = frontier = checkpointed(colours.where("id = colour"))
        while frontier.limit(1).count():
            back = inner.join(frontier.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            frontier = checkpointed(back.join(members, "id", "left_anti"))
            members = checkpointed(members.unionByName(frontier))
        least = members.groupBy("colour").agg(F.min("id").alias("cycle"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        found = found.unionByName(members.join(least, "colour").select("id", "cycle"))
        gone = members.select("id")
        e = checkpointed(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    for members in reversed(shortened):  # a chain is on a cycle where both its ends are in one set, or are one node
        at = lambda c: found.select(F.col("id").alias(c), F.col("cycle").alias(f"_{c}"))  # noqa: B023, E731
        met = members.join(at("src"), "src", "left").join(at("dst"), "dst", "left").where("src = dst or _src = _dst")
        met = met.select(F.inline(F.array(F.struct("id", F.coalesce("_src", "src").alias("cycle")), F.struct(F.col("src").alias("id"), F.coalesce("_src", "src").alias("cycle")))))
        found = checkpointed(found.unionByName(met).distinct())
    least = found.groupBy("cycle").agg(F.min("id").alias("_least"))
    found = found.join(least, "cycle").select("id", F.col("_least").alias("cycle")).unionByName(loops)
    return found.groupBy("id").agg(F.min("cycle").alias("cycle"))


def resolve_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (target_path) with dst and state: RESOLVED where one node has the path or, failing that,
    one node has the link's name; AMBIGUOUS where several have the name; MISSING otherwise."""
    paths = nodes.groupBy(F.lower("path").alias("_p")).agg(F.min("id").alias("_by_path"))
    names = nodes.groupBy(F.lower("name").alias("_n")).agg(F.min("id").alias("_by_name"), F.countDistinct("id").alias("_many"))
    stem = F.regexp_replace(F.regexp_extract(F.lower("target_path"), r"([^/]*)$", 1), r"\.md$", "")
    rows = edges.join(paths, F.lower("target_path") == F.col("_p"), "left").join(names, stem == F.col("_n"), "left")
    dst = F.when(F.col("_by_path").isNotNull(), F.col("_by_path")).when(F.col("_many") == 1, F.col("_by_name"))
    state = F.when(dst.isNotNull(), "RESOLVED").when(F.col("_many") > 1, "AMBIGUOUS").otherwise("MISSING")
    return rows.select(*edges.columns, dst.alias("dst"), state.alias("state"))
