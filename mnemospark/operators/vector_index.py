"""A stored index of vectors by trained centroids, nearest neighbours of many queries at once, and keys for blocking.

Vectors lie in lists, one for each centroid, sorted by list so that a query reads the lists it probes and
Parquet's statistics leave out the rest. A list has cells of bounded size, so that one with a third of all
vectors is as many pieces of work as any other third. Distances are of the cosine; an exact way beside the
index compares the queries with all vectors, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemospark.functions.text import cosine_to, distance_score, dot
from mnemospark.session import kept_folder

#: Vectors of a cell and queries of a block, about: a task compares so many with so many at once.
CELL, QUERY_BLOCK = 4096, 1024
#: Centroids are trained on at most so many vectors (those with the lowest hashes of their keys), and
#: there are at most so many lists.
SAMPLE_MOST, LISTS_MOST = 50_000, 4096
#: The recall of ten neighbours that the stored number of probes has to reach on the sample.
TARGET_RECALL = 0.95


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of no length stay."""
    size = np.sqrt((v * v).sum(axis=1))
    return v / np.where(size > 0, size, 1)[:, None]


def train_centroids(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Spherical k-means: centroids at length 1. They start far from each other, each in proportion to its
    squared distance from those before it; a centroid that loses all its vectors takes the one that lies worst."""
    v, rng = unit(sample), np.random.default_rng(seed)
    c = np.empty((min(lists, len(v)), v.shape[1]))
    if not len(c):
        return c
    c[0] = v[rng.integers(len(v))]
    away = np.maximum(1 - v @ c[0], 0)
    for i in range(1, len(c)):
        p = away / away.sum() if away.sum() > 0 else None
        c[i] = v[rng.choice(len(v), p=p)]
        away = np.minimum(away, np.maximum(1 - v @ c[i], 0))
    for _ in range(rounds):
        near = v @ c.T
        where = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, where, v)
        empty = np.flatnonzero(np.bincount(where, minlength=len(c)) == 0)
        total[empty] = v[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        c = unit(total)
    return c


def calibrated_probes(sample: np.ndarray, centroids: np.ndarray, target: float = TARGET_RECALL, k: int = 10, queries: int = 256) -> int:
    """The least number of lists that finds target of the k nearest others of some of the sample's vectors. How
    many that is depends on the data: few where vectors lie in clusters, many where they hardly do."""
    v = unit(sample)
    if len(v) < 2 or len(centroids) < 2:
        return max(1, len(centroids))
    q = np.unique(np.linspace(0, len(v) - 1, queries).astype(int))
    near = v[q] @ v.T
    near[np.arange(len(q)), q] = -9
    true = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(v) - 1)]
    place = np.argsort(np.argsort(-(v[q] @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list, from 0
    lists = (v @ centroids.T).argmax(axis=1)[true]
    needed = np.sort(np.take_along_axis(place, lists, axis=1).ravel())
    return int(needed[math.ceil(target * len(needed)) - 1]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass(frozen=True)
class VectorIndex:
    """vectors: list, cell, key, vector, norm and the columns that were kept; lists: list, cells, centroid,
    probes."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    @property
    def probes(self) -> int:
        """How many lists reach TARGET_RECALL on the sample that the index was trained on."""
        found = self.lists.select("probes").first()
        return found["probes"] if found else 1

    def centroids(self) -> np.ndarray:
        """At most LISTS_MOST rows, by list."""
        return np.array([r["centroid"] for r in self.lists.orderBy("list").select("centroid").collect()], dtype=float)


def write_index(rows: DataFrame, path: str, key: str, vector: str, *, dims: int, keep: tuple[str, ...] = (), lists: int | None = None) -> VectorIndex:
    """Writes the index of the rows whose vector has dims components, none null or not finite; others,
    null keys too, are left out. lists: how many, the root of the number of vectors unless given.

    The sample's bound is SAMPLE_MOST vectors whatever the input; all vectors are indexed: one pass
    deals them to lists, one shuffle sorts them by list and cell."""
    spark = rows.sparkSession
    good = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"), *keep)
    n = rows.count()
    wanted = lists or min(LISTS_MOST, max(1, round(math.sqrt(n))))
    sample = rows.select("key", "vector").orderBy(F.xxhash64("key"), "key", "vector").limit(min(SAMPLE_MOST, 64 * wanted)).collect()
    sample = np.array([r["vector"] for r in sample], dtype=float).reshape(-1, dims)
    c = train_centroids(sample, wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vector")).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((unit(v) @ c.T).argmax(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))], [*b.schema.names, "list"])

    dealt = rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())]))
    dealt = dealt.withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    dealt.write.parquet(f"{path}/dealt")
    dealt = spark.read.parquet(f"{path}/dealt")
    sizes = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    probes = calibrated_probes(sample, c)
    centroids = spark.createDataFrame([(i, x.tolist(), probes) for i, x in enumerate(c)], "list int, centroid array<double>, probes int")
    centroids.join(sizes, "list", "left").fillna(0, ["cells"]).write.parquet(f"{path}/lists")
    index = VectorIndex(spark, path)
    cells = dealt.join(F.broadcast(index.lists.select("list", "cells")), "list").withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
    cells.drop("cells").repartitionByRange("list", "cell").sortWithinPartitions("list", "cell", "key").write.parquet(f"{path}/vectors")
    return index


def kept_index(source: DataFrame, name: str, key: str, vector: str, *, dims: int, keep: tuple[str, ...] = ()) -> VectorIndex:
    """The index of a table in the shared folder, written where it isn't there yet for these files."""
    path = kept_folder(source, f"vector-index-{name}", "vectors", lambda to: write_index(source, to, key, vector, dims=dims, keep=keep))
    return VectorIndex(source.sparkSession, path)


def search(index: VectorIndex, query: list[float], k: int, *, probes: int | None = None, keep: Column | None = None) -> DataFrame:
    """key, distance, score of the k nearest vectors; ties by key. probes: how many lists are read, the nearest
    first (unless given all are, which is exact). keep: which rows may be found, such as those of a model and
    a fingerprint; it is applied before the limit. An empty query finds nothing."""
    rows = index.vectors if query else index.vectors.where(F.lit(False))
    if probes is not None and query:
        near = np.argsort(-(index.centroids() @ np.asarray(query, dtype=float)), kind="stable")[:probes]
        rows = rows.where(F.col("list").isin(near.tolist()))
    rows = rows if keep is None else rows.where(keep)
    scored = rows.select("key", (1 - cosine_to(F.col("vector"), list(query), F.col("norm"))).alias("distance"))
    return scored.withColumn("score", distance_score(F.col("distance"))).orderBy("distance", "key").limit(k)


def nearest(index: VectorIndex, queries: DataFrame, k: int, *, probes: int | None = None, themselves: bool = False) -> DataFrame:
    """query, key, distance, place of the k nearest vectors of each query (query, vector). probes: the lists
    each query looks into; unless given all of them, which compares every query with every vector, in
    blocks, and is exact. themselves: whether a vector may be its own neighbour.

    A task compares a block of queries with a cell of vectors, both of bounded size, and sends k rows a
    query; lists with more vectors or more queries have more tasks."""
    dims = len(index.lists.select("centroid").first()["centroid"]) if index.lists.take(1) else 1
    c = index.centroids() if probes is not None else np.zeros((0, dims))
    asked = queries.select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == dims)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("vector")).reshape(-1, dims)
            near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["query", "vector", "lists"])

    if probes is None:
        met = asked.join(F.broadcast(index.lists.where("cells > 0").select("list", "cells").agg(F.collect_list(F.struct("list", "cells")).alias("l"))), how="cross")
        met = met.select("query", "vector", F.explode("l").alias("l")).select("query", "vector", "l.list", "l.cells")
    else:
        met = asked.mapInArrow(probe, "query bigint, vector array<double>, lists array<int>").select("query", "vector", F.explode("lists").alias("list"))
        met = met.join(F.broadcast(index.lists.where("cells > 0").select("list", "cells")), "list")
    # how many blocks a list's queries make: a row a list
    blocks = met.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    met = met.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    met = met.select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "block", "query", "vector")
    held = index.vectors.join(F.broadcast(blocks), "list").select("list", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "vector")

    def compare(_, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "key": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        have = have.sort_values("key", kind="stable")
        keys, q = have["key"].to_numpy(), ask["query"].to_numpy()
        d = 1 - unit(np.array(ask["vector"].tolist())) @ unit(np.array(have["vector"].tolist())).T
        if not themselves:
            d[q[:, None] == keys[None, :]] = np.inf
        best = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query": np.repeat(q, best.shape[1]), "key": keys[best].ravel(), "distance": np.take_along_axis(d, best, axis=1).ravel()})
        return out[np.isfinite(out["distance"])]

    group = ["list", "cell", "block"]
    some = met.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(compare, "query bigint, key bigint, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "key"))
    return some.withColumn("place", place).where(F.col("place") <= k).select("query", "key", "distance", "place")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: queries, and recall: the mean share of each query's true k nearest (query, key) that was found."""
    hit = truth.join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    per = hit.groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"))


def band_bits(n: int, groups: int = 1, block: int = 32) -> int:
    """How many signs a blocking key needs so that a block has about so many of n vectors in groups."""
    return max(0, math.ceil(math.log2(max(n, 1) / (groups * block))))


def sign_bands(vector: Column, bits: int, bands: int = 2) -> Column:
    """Blocking keys of a vector: for each band the signs of bits components, each band's own. Near
    vectors agree in most signs, so the more bands, the more near pairs meet."""
    bit = lambda band, i: F.when(F.get(vector, F.lit(band * bits + i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    key = lambda band: sum((bit(band, i) for i in range(bits)), F.lit(0).cast("long"))
    return F.array(*[F.concat_ws(":", F.lit(str(band)), key(band).cast("string")) for band in range(bands)])
