"""functions of the engine, and their names in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _token_count(texts: pd.Series) -> pd.Series:
    import regex

    word = regex.compile(r"[\p{L}\p{N}_]+")
    return texts.map(lambda t: None if t is None else sum(1 for _ in word.finditer(t)))


def _folded(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC").str.casefold().str.normalize("NFC")


def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    import numpy as np

    def one(x, y) -> float:
        size = 0.0 if x is None or y is None or len(x) != len(y) else float(np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))
        return float(np.dot(x, y)) / size if size else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


class _Tokens:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        import regex

        for i, t in enumerate(regex.findall(r"[\p{L}\p{N}_]+", text or "")):
            yield i, t


def register(spark: SparkSession) -> None:
    """The functions that SQL has no built-in for: mnemo_token_count, mnemo_folded, mnemo_cosine, and the
    table function mnemo_tokens(text)."""
    spark.udf.register("mnemo_token_count", F.pandas_udf(_token_count, "int"))
    spark.udf.register("mnemo_folded", F.pandas_udf(_folded, "string"))
    spark.udf.register("mnemo_cosine", F.pandas_udf(_cosine, "double"))
    spark.udtf.register("mnemo_tokens", F.udtf(_Tokens, returnType="place int, token string"))
