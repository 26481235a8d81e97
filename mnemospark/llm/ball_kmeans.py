"""Exact k-means by balls: clusters with radii, neighbour centroids, stable cores and annuli.

The members of a cluster lie in a ball around its centroid. With a member at distance a of its own
centroid and another centroid at distance D of that one, the triangle inequality puts the member at
D - a or more from the other: while 2a < D the other can be neither nearer nor as near. So

* a centroid is a neighbour of a ball of radius r only if D <= 2r;
* members with 2a < D for all neighbours are the ball's stable core and compared with none;
* the rest fall into annuli between halves of the neighbours' distances: a member of the m-th annulus
  is compared with the m nearest neighbours, exactly.

Components are integers, so all of this is decided on squares, 4a^2 < D^2, without rounding. A ball is
made of one batch's members of a cluster: its radius is at most the whole cluster's, so it has no
more neighbours than that, and a round is one pass. Centroids are k rows whatever the input."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm.common import stored

#: Vectors of a slice; what is made of one at once is about 16 kB a vector at k = 16.
SLICE = 8192
#: Largest absolute component: squares of distances over 64 of them then fit a long.
MOST = 2**27


@dataclass
class Result:
    """vectors: the kept rows with cluster and distance (stored); centroids: the final ones, a list
    of integers each, by number."""

    vectors: DataFrame
    centroids: list[list[int]]


def integer_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have dims components, none of them null or not finite; and
    floor(scale * x) of the components of those rows."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False))
    fit = lengths == dims
    flat = pc.list_flatten(column.filter(pa.array(fit)))
    values = np.asarray(pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    keep = np.flatnonzero(fit)[finite]
    values = np.floor(scale * values[finite])
    if len(values) and np.abs(values).max() > MOST:
        raise ValueError(f"a component times {scale} is over {MOST}: its squares don't fit a long")
    return keep, values.astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors (rows) to centroids (columns), exact."""
    high = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4 * vectors.shape[1] * int(high) ** 2 < 2**53 else np.int64  # doubles are exact that far
    v, c = vectors.astype(kind), centroids.astype(kind)
    if kind is np.float64:
        return ((v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (v @ c.T)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


def reassign(vectors: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (of equally near ones the first), the squared distance to
    it, and how many distances to other centroids were computed. cluster: where each vector was."""
    between = distances(centroids, centroids)
    out, best, compared = cluster.copy(), np.zeros(len(vectors), dtype=np.int64), 0
    for i in np.unique(cluster):
        ball = np.flatnonzero(cluster == i)
        own = distances(vectors[ball], centroids[i : i + 1])[:, 0]
        best[ball] = own
        near = np.argsort(between[i], kind="stable")
        near = near[(near != i) & (between[i][near] <= 4 * own.max())]  # neighbours, nearest first
        annulus = np.searchsorted(between[i][near], 4 * own, side="right")  # 0: the stable core
        for m in np.unique(annulus[annulus > 0]):
            ring = np.flatnonzero(annulus == m)
            who = np.append(near[:m], i)
            d = np.concatenate([distances(vectors[ball[ring]], centroids[near[:m]]), own[ring, None]], axis=1)
            compared += d.size - len(d)
            order = np.argsort(who)  # of equal distances the smaller number counts
            pick = order[np.argmin(d[:, order], axis=1)]
            out[ball[ring]], best[ball[ring]] = who[pick], d[np.arange(len(d)), pick]
    return out, best, compared


def ball_kmeans(docs: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> Result:
    """k-means of the vectors with dims components, none null or not finite, each taken as
    floor(scale * x): Result with one row (key, cluster, distance) for each of them.

    Centroids start as the k vectors with the smallest sha256 of `seed:key`; each round assigns all
    vectors and replaces each centroid that has some by the floor of their mean; then they are
    assigned once more. Ties go to the smaller number; a cluster without vectors keeps its centroid.

    Null keys are kept and hash as the empty word. Repeated rows are vectors of their own; of rows
    with one key the smaller vector starts first. Fewer than k vectors give as many centroids, none
    give an empty result. Components beyond 2**27 raise, as squares of distances would not fit a
    long. Other columns are ignored.

    Scale: vectors are read once and written once a round, in integers beside their cluster; a batch
    sends k sums of a component each, whatever its size, so a cluster with a third of all vectors is
    summed where its members lie. The driver holds k centroids."""
    fields = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("hash", T.StringType()), T.StructField("v", T.ArrayType(T.IntegerType()))])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                s = b.slice(at, SLICE)
                keep, v = integer_vectors(s.column("x"), dims, scale)
                flat = pa.array(v.ravel().astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims), flat)
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(keep)), s.column("hash").take(pa.array(keep)), lists], ["key", "hash", "v"])

    kept = stored(docs.select(F.col(key).alias("key"), digest.alias("hash"), F.col(vector).alias("x")).mapInArrow(prepare, fields), "ball-vectors")
    first = kept.orderBy("hash", "v").limit(k).select("v").collect()  # k rows
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dims)
    assigned = kept.select("key", "v", F.lit(None).cast("int").alias("cluster"))
    if not len(centroids):
        return Result(kept.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    for turn in range(rounds + 1):
        assigned = stored(_assigned(assigned, centroids), f"ball-round{turn}")
        if turn < rounds:
            centroids = _means(assigned, centroids)
    return Result(assigned.select(F.col("key").alias(key), "cluster", "distance"), centroids.tolist())


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (key, v, cluster) with the cluster of these centroids, and distance. Where cluster is null
    every centroid is compared, as there are no balls yet."""
    dims = centroids.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                s = b.slice(at, SLICE)
                v = s.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                before = s.column("cluster")
                if before.null_count:
                    d = distances(v, centroids)
                    cluster = np.argmin(d, axis=1)
                    best = d[np.arange(len(d)), cluster]
                else:
                    cluster, best, _ = reassign(v, before.to_numpy(zero_copy_only=False).astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([s.column("key"), s.column("v"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["key", "v", "cluster", "distance"])

    fields = T.StructType([rows.schema["key"], rows.schema["v"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return rows.mapInArrow(apply, fields)


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each cluster's vectors; centroids without vectors stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:  # a task's sums: 2**36 vectors at 2**27 would fill a long
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            cluster = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            count += np.bincount(cluster, minlength=k)
            for i in np.unique(cluster):
                total[i] += v[cluster == i].sum(axis=0)
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * dims), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), lists], ["cluster", "n", "sums"])

    part = rows.select("v", "cluster").mapInArrow(sums, "cluster int, n bigint, sums array<bigint>")
    wide = [F.sum(F.get("sums", F.lit(j)).cast("decimal(28,0)")).alias(f"s{j}") for j in range(dims)]
    out = centroids.copy()
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dims)]
    return out


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
