"""Near duplicates by min-max hashing: signatures, bands, confirmed links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import raw_bytes, slices, stored
from mnemospark.llm.word_hash import BYTE_BASE, WORD_BASE, mixed, word_hashes

#: Values of a band and bands. A pair at similarity 0.8 shares none of 30 bands of 5 with
#: probability (1 - 0.8**5)**30, 7 in a million; at 0.85, 2 in a hundred million.
ROWS, BANDS = 5, 30
#: Bytes of a shingle's hash.
WIDTH = 8


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles of width words, one text after the other,
    and how many each has. A text with fewer words has its whole sequence as one, without words none."""
    h, starts = word_hashes(lowered(data), at)
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - starts[:-1][text]
    grams = np.zeros(len(h), dtype=np.uint64)
    taken = np.minimum(counts[text] - place, width)  # words from here on, width at most
    for j in range(width):
        more = np.flatnonzero(taken > j)
        grams[more] = grams[more] * np.uint64(WORD_BASE) + h[more + j] + np.uint64(BYTE_BASE)
    use = (place + width <= counts[text]) | ((place == 0) & (counts[text] < width))
    grams, text = mixed(grams[use]), text[use]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.bincount(text[new], minlength=len(counts))


def band_keys(grams: np.ndarray, sizes: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A row of band keys for each text that has shingles.

    Under each permutation both the lowest and the highest value count: each agrees for two sets
    with probability equal to their similarity, so rows * bands values take half as many hashes."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(starts):
        return np.zeros((0, bands), dtype=np.uint64)
    rng = np.random.default_rng(23)
    half = -(-rows * bands // 2)
    a = rng.integers(0, 2**63, half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, half, dtype=np.uint64)
    values = np.empty((len(starts), 2 * half), dtype=np.uint64)
    for i in range(half):
        p = (grams ^ b[i]) * a[i]
        p ^= p >> np.uint64(32)
        p *= a[i]
        values[:, i] = np.minimum.reduceat(p, starts)
        values[:, half + i] = np.maximum.reduceat(p, starts)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(starts), axis=0)
    for r in range(rows):
        keys = mixed(keys * np.uint64(WORD_BASE) + values[:, r * bands : (r + 1) * bands])
    return keys


def connected(edges: DataFrame, name: str) -> DataFrame:
    """node, root for each node of edges (a, b): root is the smallest node that can be reached.

    Large and small stars in turn, until only stars are left: each edge moves to the lowest neighbour of
    one end, so chains halve and every component ends as a star around its smallest node; rounds go
    on until that is so, about as many as the logarithm of the longest chain. A node
    with very many neighbours is one row of minima to be joined with, never a group to be gathered."""
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u != v").distinct()
    while True:
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")).withColumnRenamed("v", "c")
        large = both.join(low, both["v"] == low["c"]).where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u != v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "c")
        small = large.join(low, large["v"] == low["c"])
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select(F.col("c").alias("v"), F.col("m").alias("u")))
        e = stored(small.where("u != v").distinct(), f"{name}-stars")
        inner = e.select("v").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if e.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v").union(inner).isEmpty():
            break  # every node hangs on one other, which hangs on none
    roots = e.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")
    return roots.union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


class NearDuplicates:
    """The steps of components(); each leaves a small stored table."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int):
        self.percent, self.width = percent, width
        self.rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        self.base = stored(self._signatures(), "near-signatures")

    def _signatures(self) -> DataFrame:
        width = self.width

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "text"):
                grams, sizes = shingle_sets(*raw_bytes(s.column("text")), width)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                # the whole set's name: two sums of well mixed hashes, as the order of a set is none
                one, two = (np.concatenate([[0], np.cumsum(mixed(grams ^ np.uint64(c)))]).astype(np.uint64) for c in (1, 2))
                keys = np.zeros((len(sizes), BANDS), dtype=np.uint64)
                keys[sizes > 0] = band_keys(grams, sizes, ROWS, BANDS)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]), pa.int32()), pa.array(keys[sizes > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.array(sizes, pa.int64()), pa.array((one[ends[1:]] - one[ends[:-1]]).view(np.int64)), pa.array((two[ends[1:]] - two[ends[:-1]]).view(np.int64)), bands],
                    ["doc_id", "n", "k1", "k2", "bands"],
                )

        return self.rows.mapInArrow(apply, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")

    def sets(self, ids: DataFrame) -> DataFrame:
        """doc_id, grams (the whole set) of the documents named, made from their texts again."""
        width = self.width

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "text"):
                grams, sizes = shingle_sets(*raw_bytes(s.column("text")), width)
                raw, ends = grams.astype("<u8").tobytes(), (np.cumsum(sizes) * WIDTH).tolist()
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([raw[e - WIDTH * n : e] for e, n in zip(ends, sizes.tolist(), strict=True)], pa.binary())], ["doc_id", "grams"])

        return self.rows.join(ids, "doc_id", "left_semi").mapInArrow(apply, "doc_id bigint, grams binary")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, by the sets themselves."""
        percent = self.percent

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "x"):
                good = []
                for x, y in zip(s.column("x").to_pylist(), s.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield s.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(apply, "a bigint, b bigint")

    def fits(self, n: str, m: str):
        """Sets of these sizes can be similar enough."""
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def roots(self) -> tuple[DataFrame, DataFrame]:
        """rep, k1, k2 of each different set (rep is the smallest doc_id that has it), and rep, root."""
        use = self.base.where("n > 0 and doc_id is not null")
        classes = stored(use.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "near-classes")
        reps = use.join(classes, (use["doc_id"] == classes["rep"]) & (use["k1"] == classes["k1"]) & (use["k2"] == classes["k2"]), "left_semi")
        banded = reps.select("doc_id", "n", F.explode("bands").alias("band"))
        buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("pivot")).where("c > 1")
        members = stored(banded.join(buckets, "band").select("band", "doc_id", "n", "pivot"), "near-members")
        sets = stored(self.sets(members.select("doc_id").distinct()), "near-sets")
        sizes = members.where("doc_id = pivot").select("pivot", F.col("n").alias("pivot_n")).distinct()
        # every document against the smallest of each of its buckets
        stars = members.where("doc_id != pivot").groupBy("doc_id", "pivot").agg(F.max("n").alias("n"))
        stars = stored(stars.join(sizes, "pivot").where(self.fits("n", "pivot_n")).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")), "near-stars")
        roots = stored(connected(stored(self.confirmed(stars, sets), "near-links"), "near-1"), "near-roots")
        # what is still apart in a bucket: members out of its largest component against all the others
        named = members.join(roots, members["doc_id"] == roots["node"], "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        shares = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
        largest = shares.groupBy("band").agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("band", "main")
        apart = stored(named.join(largest, "band").groupBy("doc_id", "root").agg(F.bool_or(F.col("root") != F.col("main")).alias("out")), "near-apart")
        prefixes = stored(self._prefixes(apart, sets), "near-prefixes")
        few = prefixes.where("out").select("gram", F.col("doc_id").alias("a"), F.col("root").alias("ar"), F.col("n").alias("an"), F.col("i").alias("ai"))
        reach = 1 + F.least(F.col("n") - F.col("i"), F.col("an") - F.col("ai"))  # shingles in common, at most, if this is the first
        pairs = few.join(prefixes, "gram").where((F.col("ar") != F.col("root")) & (reach * (100 + self.percent) >= self.percent * (F.col("n") + F.col("an"))))
        pairs = pairs.select(F.greatest("a", "doc_id").alias("a"), F.least("a", "doc_id").alias("b")).distinct()
        links = stored(self.confirmed(pairs.join(stars, ["a", "b"], "left_anti"), sets), "near-links")
        if not links.isEmpty():
            known = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = stored(connected(known.union(links), "near-2"), "near-roots")
        return classes, roots

    def _prefixes(self, docs: DataFrame, sets: DataFrame) -> DataFrame:
        """The columns of docs, n, gram, i for the rarest shingles of each: in the order of how many
        of docs have them, two sets that are similar enough share one of the first n - percent * n / 100 + 1."""

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "grams"):
                raw = s.column("grams").to_pylist()
                n = np.array([len(r) // WIDTH for r in raw], dtype=np.int64)
                of = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), dtype="<i8")), pa.array(np.repeat(n, n)), *(s.column(c).take(of) for c in ("doc_id", "root", "out"))], ["gram", "n", "doc_id", "root", "out"])

        rows = sets.join(docs, "doc_id").select("doc_id", "root", "out", "grams").mapInArrow(apply, "gram bigint, n bigint, doc_id bigint, root bigint, out boolean")
        rows = stored(rows, "near-grams")
        ranked = rows.join(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
        ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "gram")))
        return ranked.where(100 * (F.col("i") - 1) <= (100 - self.percent) * F.col("n")).drop("df")


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: texts whose sets of width-word shingles (A-Z in
    lower case) have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id that links lead to, a document's own if it has none.

    Texts without words have no set and are linked with nothing; so are rows whose key is null
    (their component is null). Rows that share a key are one document. Equal sets collapse to their
    smallest key before anything is compared, so copies cost a row each, whatever their number. An
    empty table gives none; other columns are ignored.

    Links are found where two sets share a band of the min-max signature, and each counts only once
    confirmed on the sets themselves. In a bucket, documents meet its smallest member; those not
    joined with the others by then are held against all that share one of their rarest shingles, as
    any set must that is similar enough. No link between different
    texts is given up for a bucket's size."""
    near = NearDuplicates(docs, key, text, width, percent)
    classes, roots = near.roots()
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("k1", "k2", F.coalesce("root", "rep").alias("component"))
    base = near.base.select("doc_id", "n", "k1", "k2")
    joined = base.join(named, ["k1", "k2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
