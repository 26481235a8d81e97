"""A corpus from raw documents to packed sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import language, minhash, mixing, packing, substring
from mnemospark.llm.common import WORD, scratch, shared_path, tokenizer_path

#: Texts whose likeliest language has less probability than this are in none that the network knows.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters (null and empty texts among them), and
    those in none of the languages, go. Rows are filtered one by one: repeated rows and null keys stay,
    other columns too; an empty table gives none."""
    net = language.train(docs, none=True)
    found = language.identify(docs, net, whole=True).where((F.col("lang_pred") != language.NONE) & (F.col("score") >= LEAST_SCORE))
    return found.select(docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs and _key: doc_id, or for null one made of the text, above those in use."""
    made = F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), made))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity of 0.8 or more):
    the one with the smallest doc_id.

    Rows that share a doc_id are one document, so they stay or go together. Of equal texts without
    a doc_id one is kept, the row whose other columns come first as JSON; texts without words are no
    duplicates of anything. All columns stay; an empty table gives none."""
    # rows that share a key are one document, so of equal texts without a doc_id one is taken first
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    row = F.struct(*docs.columns)
    one = docs.where(nameless).groupBy("text").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    rows = _keyed(docs.where(~nameless).unionByName(one))
    kept = minhash.components(rows, key="_key", width=5).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(kept, "_key", "left_semi").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that stand earlier in the corpus. A document
    of which nothing is left goes, and so do null and empty texts; n_chars, where there, is counted anew.

    Documents go by doc_id; those without one come last, in the order of their hashes. Repeated rows
    stay as often as they are there. Other columns stay with their row; an empty table gives none."""
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("rest")
    left = substring.dedup(_keyed(docs).select("_key", "text", rest), key="_key", layout=True, keep="rest")
    left = left.select("rest.*", F.col("kept_words").alias("text")).where("text != ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them, with all their columns.
    A null source is one of its own; null keys are mixed too; texts without words are not taken; an
    empty table gives none."""
    return mixing.mixed_rows(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their ids. Every row is packed, repeated
    ones, null keys and texts without words (their end id) too; an empty table gives none."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Networks, hashes of neighbourhoods and tokenizers aren't SQL; tests/llm hold the rows of each stage
#: against what its rule says by hand (the first against the text's own language).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):  # what the stage stored on its way isn't needed any more
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
