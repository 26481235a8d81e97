"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.byte_net import ByteNet, labelled_sample


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 500, longest: int = 8_000) -> ByteNet | None:
    """A network fitted on at most per_label documents of each label (0 and 1); of texts over longest
    characters, on windows from the first to the last character that have longest in all: the sample
    is bounded by these two. None where no labelled document exists."""
    marks = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    sample = labelled_sample(docs, marks, key=key, text=text, per_label=per_label, longest=longest)
    if not sample:
        return None
    net = ByteNet([0, 1], widths=(4,), filters=16, block=256, chunk=2, with_max=True)
    return net.fit([t for _, t in sample], np.array([y for y, _ in sample]), epochs=6)


def score(docs: DataFrame, net: ByteNet | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, the probability of label 1, for every row of docs.

    The whole text counts, whatever its length. Null and empty texts are scored as one empty block;
    without a network every score is 0.5. Repeated rows and null keys keep their rows, equal texts
    get equal scores, an empty table gives none; other columns are ignored. Nothing is shuffled."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    return net.scored(rows, "text", "_p").select("doc_id", F.col("_p")[1].alias("score"))
