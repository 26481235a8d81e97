"""Embedding as a function of text: a deterministic embedder, batches, and what their results must hold."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.projection import batches


def _byte_vector(t: str, dims: int) -> np.ndarray:
    raw = np.frombuffer(t.encode(), dtype=np.uint8).astype(np.float64) / 255.0
    v = np.bincount(np.arange(len(raw)) % dims, weights=raw, minlength=dims)
    return v / (np.sqrt((v * v).sum()) or 1.0)


def byte_embedding(text: Column, dims: int = 8) -> Column:
    """A text's UTF-8 bytes, each over 255, dealt in turn to dims places and scaled to length 1; zeros for
    an empty text, null for null. It stands in for a model where none is at hand."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _byte_vector(t, dims))

    return embed(text)


class Provider(Protocol):
    """What embeds texts. An object that can be pickled; what start() returns need not be."""

    model: str
    dimensions: int

    def start(self) -> Callable[[list[str]], list]:
        """Loads the model; what it returns gives a list of texts its vectors, in order."""


class ByteProvider:
    """byte_embedding() as a provider; a text with the refused word fails, as a model may fail on an input."""

    def __init__(self, dimensions: int = 8, refused: str | None = None):
        self.model, self.dimensions, self.refused = "bytes", dimensions, refused

    def start(self) -> Callable[[list[str]], list]:
        def embed(texts: list[str]) -> list:
            if self.refused and any(self.refused in t for t in texts):
                raise ValueError("refused")
            return [_byte_vector(t, self.dimensions) for t in texts]

        return embed


def fingerprint(provider: Provider) -> str:
    """Names the vectors of a provider: those of another model or size are stale."""
    return hashlib.sha256(f"{provider.model}:{provider.dimensions}".encode()).hexdigest()


#: Started models of this worker process, by their pickled providers.
_STARTED: dict[bytes, Callable[[list[str]], list]] = {}


def _started(pickled: bytes) -> Callable[[list[str]], list]:
    if pickled not in _STARTED:
        _STARTED[pickled] = cloudpickle.loads(pickled).start()
    return _STARTED[pickled]


def _answers(embed: Callable[[list[str]], list], texts: list[str]) -> list[tuple]:
    """(vector, error) of each text of a batch. A batch that fails, or gives another number of vectors, is asked
    again text by text, so that only those at fault are set aside."""
    if not texts:
        return []
    try:
        vectors = list(embed(texts))
    except Exception:  # a model's own errors are of any kind
        vectors = None
    if vectors is not None and len(vectors) == len(texts):
        return [(v, None) for v in vectors]
    if len(texts) == 1:
        return [(None, "INFERENCE_FAILED" if vectors is None else "CARDINALITY_MISMATCH")]
    return [a for t in texts for a in _answers(embed, [t])]


def inferred(items: DataFrame, key: str, text: str, provider: Provider, batch: int = 32) -> DataFrame:
    """key, embedding, error of every row of items, in the order of its partitions.

    A model starts once a worker process and serves all tasks there. It is asked for batch texts at a time, whatever
    batches Arrow brings. A null text is no question: MISSING_TEXT. One at which the model fails has INFERENCE_FAILED or
    CARDINALITY_MISMATCH; odd vectors have the codes of vector_error(). Repeated keys give a row each."""
    if batch < 1:
        raise ValueError("a batch has at least one text")
    pickled = cloudpickle.dumps(provider)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed, keys, texts = None, [], []

        def answered() -> pd.DataFrame:
            found = iter(_answers(embed, [t for t in texts if t is not None]))
            rows = [(k, *((None, "MISSING_TEXT") if t is None else next(found))) for k, t in zip(keys, texts, strict=True)]
            return pd.DataFrame({"_k": pd.Series([r[0] for r in rows], dtype=object), "embedding": [r[1] for r in rows], "_e": [r[2] for r in rows]})

        for f in frames:
            embed = embed or _started(pickled)
            for k, t in zip(f["_k"], f["_t"], strict=True):
                keys.append(k)
                texts.append(t)
                if len(texts) == batch:
                    yield answered()
                    keys, texts = [], []
        if texts:
            yield answered()

    kind = dict(items.select(F.col(key).alias("_k")).dtypes)["_k"]
    # keys travel as text: pandas would make doubles of whole numbers among nulls
    found = items.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t")).mapInPandas(run, "_k string, embedding array<double>, _e string")
    error = F.coalesce("_e", vector_error(F.col("embedding"), provider.dimensions))
    return found.select(F.col("_k").cast(kind).alias(key), F.when(error.isNull(), F.col("embedding")).alias("embedding"), error.alias("error"))


def register_provider(spark: SparkSession, name: str, provider: Provider, batch: int = 32) -> None:
    """The provider as an SQL function name(text): its vector, null where it fails or the text is null."""
    pickled = cloudpickle.dumps(provider)

    @F.pandas_udf("array<double>")
    def embed(batches_of: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _started(pickled)
        for texts in batches_of:
            asked = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                for i, (vector, _) in zip(part, _answers(model, [texts.iloc[i] for i in part]), strict=True):
                    out[i] = vector
            yield pd.Series(out, dtype=object)

    spark.udf.register(name, embed)


def stale(model: str, dimensions: str, print_of: str, provider: Provider, vector: str = "embedding") -> Column:
    """Whether a stored vector isn't there or is another provider's."""
    same = (F.col(model) == provider.model) & (F.col(dimensions) == provider.dimensions) & (F.col(print_of) == fingerprint(provider))
    return F.col(vector).isNull() | ~F.coalesce(same, F.lit(False))


def reindex_selection_of(sources: list[tuple[str, DataFrame]], budget: int, force: bool = False) -> DataFrame:
    """source, key, text of what to embed next, at most budget rows over all sources, which share it in their order.

    sources: names and tables of key, text, stale, embedded_at, created_at. Stale rows of the first source come first,
    those never embedded before the oldest, then those of the next; with force, rows that are current make up the rest in
    the same order. Ties go by created_at and key."""
    if budget < 1:
        raise ValueError("the budget of a reindex must be positive")
    rows = None
    for place, (name, df) in enumerate(sources):
        part = df.select(F.lit(place).alias("_n"), F.lit(name).alias("source"), F.col("key").cast("string").alias("key"), "text", F.coalesce("stale", F.lit(True)).alias("stale"), "embedded_at", "created_at")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows if force else rows.where("stale")
    return rows.orderBy(F.desc("stale"), "_n", F.col("embedded_at").asc_nulls_first(), F.col("created_at").asc_nulls_last(), "key").limit(budget).select("source", "key", "text")


def prepared(items: DataFrame, order: list[str], size: int) -> DataFrame:
    """items with batch (from 0), in an order without ties."""
    return batches(items, order, size)


def vector_error(vector: Column, dims: int) -> Column:
    """What is wrong with an inferred vector: MISSING_VECTOR, DIMENSION_MISMATCH, NON_FINITE_VECTOR; else null."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull(), "MISSING_VECTOR").when(F.size(vector) != dims, "DIMENSION_MISMATCH").when(odd, "NON_FINITE_VECTOR")


def finalised(prepared_items: DataFrame, results: DataFrame, key: str, dims: int) -> DataFrame:
    """key, embedding, error of each prepared item (by key), joined with its inferred vector; results that no
    item asked for have error UNKNOWN_ITEM."""
    both = prepared_items.select(key).withColumn("_p", F.lit(True)).join(results.select(key, "embedding").withColumn("_r", F.lit(True)), key, "full_outer")
    error = F.when(F.col("_p").isNull(), "UNKNOWN_ITEM").otherwise(vector_error(F.col("embedding"), dims))
    return both.select(key, F.when(error.isNull(), F.col("embedding")).alias("embedding"), error.alias("error"))
