"""A small convolutional network over bytes, trained and applied in numpy.

A filter of width w over one-hot bytes is a table of w x 256 weights, so convolving is adding w
table rows at each position. Texts are cut in blocks of fixed length; each filter's largest
response in a block is kept; a chunk is one block or two neighbouring ones (overlapping chunks that
cover the whole text); a text's features are the mean, and where asked the maximum, over its
chunks; a linear layer and softmax give the classes' probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemospark.llm.common import raw_bytes, slices


@dataclass
class ByteNet:
    classes: list
    widths: tuple[int, ...] = (4,)
    filters: int = 16
    block: int = 256
    chunk: int = 1
    with_max: bool = False
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.p:
            rng = np.random.default_rng(11)
            for w in self.widths:
                self.p[f"t{w}"] = (rng.standard_normal((w, 256, self.filters)) * 0.5 / np.sqrt(w)).astype(np.float32)
                self.p[f"b{w}"] = np.zeros(self.filters, dtype=np.float32)
            n = len(self.widths) * self.filters * (1 + self.with_max)
            self.p["head"] = (rng.standard_normal((n, len(self.classes))) * 0.05).astype(np.float32)
            self.p["bias"] = np.zeros(len(self.classes), dtype=np.float32)

    # -- forward ---------------------------------------------------------------------------------

    def _blocks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and last byte's end of each block, and how many blocks each text has (one at least)."""
        n = np.maximum(-(-np.diff(at) // self.block), 1)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at[:-1], n) + k * self.block, np.repeat(at[1:], n), n

    def _windows(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bytes of blocks with what the widest filter reads beyond; 0 beyond a text's end."""
        i = first[:, None] + np.arange(self.block + max(self.widths) - 1)
        return np.where(i < end[:, None], data[np.minimum(i, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)

    def _convolved(self, win: np.ndarray, w: int, pairs: list[np.ndarray] | None) -> np.ndarray:
        table, out = self.p[f"t{w}"], None
        for j in range(0, w, 2):
            if pairs and j + 1 < w:
                code = win[:, j : j + self.block].astype(np.intp) * 256 + win[:, j + 1 : j + 1 + self.block]
                x = pairs[j // 2].take(code, axis=0)
            else:
                x = table[j].take(win[:, j : j + self.block], axis=0)
                if j + 1 < w:
                    x += table[j + 1].take(win[:, j + 1 : j + 1 + self.block], axis=0)
            out = x if out is None else np.add(out, x, out=out)
        return out

    def _pairs(self, w: int) -> list[np.ndarray]:
        t = self.p[f"t{w}"]
        return [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]

    def _chunks(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last block of each chunk, and how many chunks each text has."""
        wide = (n > 1) & (self.chunk == 2)
        m = n - wide
        k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        first = np.repeat(np.cumsum(n) - n, m) + k
        return first, first + np.repeat(wide, m), m

    def features(self, data: np.ndarray, at: np.ndarray, pairs: dict | None = None) -> np.ndarray:
        first, end, n = self._blocks(data, at)
        pooled = np.empty((len(first), len(self.widths) * self.filters), dtype=np.float32)
        for i in range(0, len(first), 512):  # bounds what is in memory for a long text
            win = self._windows(data, first[i : i + 512], end[i : i + 512])
            for k, w in enumerate(self.widths):
                pooled[i : i + 512, k * self.filters : (k + 1) * self.filters] = self._convolved(win, w, pairs and pairs[w]).max(axis=1) + self.p[f"b{w}"]
        a, b, m = self._chunks(n)
        return self._joined(np.maximum(np.maximum(pooled[a], pooled[b]), 0), m)

    def _joined(self, chunks: np.ndarray, m: np.ndarray) -> np.ndarray:
        starts = np.cumsum(m) - m
        mean = np.add.reduceat(chunks, starts, axis=0) / m[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunks, starts, axis=0)], axis=1) if self.with_max else mean

    def probabilities(self, data: np.ndarray, at: np.ndarray, pairs: dict | None = None) -> np.ndarray:
        """A row for each text, a column for each class."""
        if len(at) < 2:
            return np.zeros((0, len(self.classes)))
        return softmax(self.features(data, at, pairs) @ self.p["head"] + self.p["bias"])

    # -- training --------------------------------------------------------------------------------

    def fit(self, texts: list[bytes], labels: np.ndarray, *, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 3) -> ByteNet:
        """Adam on the cross entropy; labels are places in classes. The same input, the same network."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                step += 1
                slow = rate * (1 - epoch / epochs)
                for k, g in self._gradients([texts[j] for j in pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        first, end, n = self._blocks(data, at)
        win = self._windows(data, first, end)
        best, pooled = [], []
        for w in self.widths:
            c = self._convolved(win, w, None)
            best.append(c.argmax(axis=1))
            pooled.append(np.take_along_axis(c, best[-1][:, None, :], axis=1)[:, 0, :] + self.p[f"b{w}"])
        best, pooled = np.concatenate(best, axis=1), np.concatenate(pooled, axis=1)
        a, b, m = self._chunks(n)
        of = np.where(pooled[b] > pooled[a], b[:, None], a[:, None])
        chunks = np.maximum(np.take_along_axis(pooled, of, axis=0), 0)
        u = self._joined(chunks, m)
        d = softmax(u @ self.p["head"] + self.p["bias"])
        d[np.arange(len(labels)), labels] -= 1
        d = (d / len(labels)).astype(np.float32)
        out = {"head": u.T @ d + 1e-4 * self.p["head"], "bias": d.sum(axis=0)}
        du, width = d @ self.p["head"].T, pooled.shape[1]
        text = np.repeat(np.arange(len(m)), m)
        dc = du[text, :width] / m[text, None]
        if self.with_max:
            top = chunks == u[text, width:]
            dc = dc + du[text, width:] * top / np.add.reduceat(top, np.cumsum(m) - m, axis=0)[text]
        dc = dc * (chunks > 0)
        dp = np.zeros_like(pooled)
        np.add.at(dp, (of, np.arange(width)[None, :]), dc)
        for k, w in enumerate(self.widths):
            cols = slice(k * self.filters, (k + 1) * self.filters)
            g, pos = dp[:, cols], best[:, cols]
            t = np.zeros((w, 256, self.filters), dtype=np.float32)
            column = np.broadcast_to(np.arange(self.filters), pos.shape)
            for j in range(w):
                byte = np.take_along_axis(win, pos + j, axis=1)
                t[j] = np.bincount((byte.astype(np.int64) * self.filters + column).ravel(), weights=g.ravel(), minlength=256 * self.filters).reshape(256, self.filters)
            out[f"t{w}"], out[f"b{w}"] = t, g.sum(axis=0)
        return out

    # -- on Spark --------------------------------------------------------------------------------

    def scored(self, docs: DataFrame, text: str, column: str, *, keep: bool = False) -> DataFrame:
        """docs (of simple columns) with column: an array of the classes' probabilities for the whole
        text. The text itself stays only where keep is set. A null or empty text is one empty block;
        rows are as many as before, repeated ones alike; no row gives none."""
        names, net = [c for c in docs.columns if keep or c != text], self

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = {w: net._pairs(w) for w in net.widths}
            for s in slices(batches, text):
                data, at = raw_bytes(s.column(text).fill_null(""))
                p = net.probabilities(data, at, pairs)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in names), values], [*names, column])

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
        return docs.mapInArrow(apply, f"{ddl}, `{column}` array<double>")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def spread(text: Column, longest: int, window: int) -> Column:
    """text, or where it is longer than longest characters, windows of it that lie evenly from its
    first to its last character, longest characters in all."""
    most = max(longest // window, 2)
    begin = lambda i: (F.floor(i * (F.length(text) - window) / (most - 1)) + 1).cast("int")
    cut = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.substring(text, begin(i), F.lit(window))))
    return F.when(F.length(text) <= longest, text).otherwise(cut)


def labelled_sample(docs: DataFrame, marks: DataFrame, *, key: str, text: str, per_label: int, longest: int, window: int = 256, rows_most: int = 8_192) -> list[tuple]:
    """The (label, text) pairs that a network is fitted on: for each label of marks (columns key and
    label) the per_label keys with the smallest hashes (fewer where labels are many, so that all
    together are rows_most; of over rows_most labels one row each, as none is left out), and their texts; of a text over longest characters, windows spread over
    the whole of it. So the sample is bounded by rows_most (or as many as there are labels) * longest characters, and no label is left
    out for the length of its texts. Where several rows have a key, one text of it is taken.

    Labels are counted first; only keys whose hash is low enough for their label's count are
    sorted. The keys picked are as few as the bound says, so they are broadcast to the texts."""
    rows = marks.select(F.col(key).alias("_k"), F.col("label").alias("_label"), F.xxhash64(F.col(key), F.lit(29)).alias("_h")).where("_label is not null and _k is not null")
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label, as the network has an output for each
    if not counts:
        return []
    per_label = max(1, min(per_label, rows_most // len(counts)))
    # four times the rows wanted: that a label has fewer than per_label under it is out of question
    share = {k: min(1.0, (4 * per_label + 100) / n) for k, n in counts.items()}
    limits = docs.sparkSession.createDataFrame([(k, 2**63 - 1 if b == 1 else int(b * 2**64) - 2**63) for k, b in share.items()], T.StructType([T.StructField("_label", marks.schema["label"].dataType), T.StructField("_most", T.LongType())]))
    low = rows.join(F.broadcast(limits), "_label").where(F.col("_h") <= F.col("_most")).select("_k", "_label", "_h").distinct()
    picked = low.withColumn("_r", F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_k"))).where(F.col("_r") <= per_label)
    texts = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(picked), "_k")
    found = texts.groupBy("_label", "_h", "_k").agg(F.min(spread(F.col("_text"), longest, window)).alias("_text")).collect()
    return [(r["_label"], r["_text"].encode()) for r in sorted(found, key=lambda r: (r["_label"], r["_h"], r["_text"]))]
